"""How much work operators do: what is gathered, how often, and that the results stay whole."""

import random

import numpy as np

from curatrix.llm import common, jaccard_join, paragraph_minhash, suffix_tree_lm
from curatrix.llm.common import connected_components
from test_operators import plain_components, prose, table


def test_few_edges_take_one_contraction(spark):
    edges = [(i, i + 1) for i in range(2000)]
    random.Random(2).shuffle(edges)
    found = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(8), rounds=1).collect()
    assert {(r["id"], r["component"]) for r in found} == {(i, 0) for i in range(2001)}


def test_rounds_of_stars(spark, monkeypatch):
    """Of more edges than a task contracts at a time."""
    monkeypatch.setattr(common, "_FEW", 0)
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 200)] + [(300, 300 + i) for i in range(1, 60)] + [(400 + rng.randrange(40), 400 + rng.randrange(40)) for _ in range(80)]
    label = {x: x for e in edges for x in e}
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()}
    assert got == {x: label[x] for e in edges if e[0] != e[1] for x in e} | {x: label[x] for x in got}


def test_levels_take_their_own_links(spark, monkeypatch):
    """Of a group of several blocks all links are contracted once; later levels take what they found."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 40)
    rng = random.Random(7)
    bases = [prose(rng, 120).split(" ") for _ in range(12)]
    rows = []
    for k in range(480):
        text = list(bases[k % 12])
        text[rng.randrange(len(text))] = f"z{k}"
        rows.append((k, " ".join(text), "s"))
    seen = []
    monkeypatch.setattr(jaccard_join, "connected_components", lambda edges, *a: seen.append(edges.count()) or connected_components(edges, *a))
    sets = {k: np.unique(paragraph_minhash.ngrams(paragraph_minhash.words_of([t]).hashes(), 5)) for k, t, _ in rows}
    members = spark.createDataFrame([(k, 1, len(s)) for k, s in sets.items()], "d long, met long, n long")
    shingles = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in sets.items()], "d long, shingles binary")
    got = {r["d"]: r["component"] for r in jaccard_join.group_components(members, shingles, 80, 100, disjoint=False).collect()}
    want = {i: c for (i, _, c) in plain_components(rows, 5, 80, 100)}
    assert got == want
    assert len(seen) > 1 and max(seen[1:]) < seen[0] / 2


def test_common_passages_make_no_large_group(spark, monkeypatch):
    """Sets of one group that share a passage alone aren't compared block by block; linked ones are all found, in any number of rounds."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 16)
    monkeypatch.setattr(jaccard_join, "COUNTED", 6000)
    monkeypatch.setattr(jaccard_join, "SLOT", 1000)
    rng = random.Random(17)
    passage = prose(rng, 90, 5000)
    rows = [(k, passage + " " + prose(rng, rng.choice([40, 60, 80]), 5000), "s") for k in range(200)]
    for k in range(40):  # near copies, and such that just miss or make it
        text = rows[k % 8][1].split(" ")
        for i in range(rng.choice([1, 2, 4, 6, 8])):
            text[rng.randrange(len(text))] = f"z{k}.{i}"
        rows.append((200 + k, " ".join(text), "s"))
    sets = {k: np.unique(paragraph_minhash.ngrams(paragraph_minhash.words_of([t]).hashes(), 5)) for k, t, _ in rows}
    saved, save = {}, jaccard_join.save

    def kept(df, name):
        out = save(df, name)
        saved[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "save", kept)
    members = spark.createDataFrame([(k, 1, len(s)) for k, s in sets.items()], "d long, met long, n long")
    shingles = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in sets.items()], "d long, shingles binary")
    got = {r["d"]: r["component"] for r in jaccard_join.group_components(members, shingles, 80, 100).collect()}
    label = {i: c for (i, _, c) in plain_components(rows, 5, 80, 100)}
    linked = set(label.values()) & {label[i] for i in label if label[i] != i}
    assert {i: c for i, c in got.items() if c in linked} == {i: c for i, c in label.items() if c in linked} and all(got[i] == i for i in got if got[i] not in linked)
    assert "jaccard-pairs" not in saved and saved["jaccard-sets"] < 60


def test_units_stay_with_their_text(spark, monkeypatch):
    """Places of units are a row for each text, and short windows of one document are in no later table."""
    rng = random.Random(8)
    shared = prose(rng, 60, 5000)
    rows = [(i, prose(rng, 400, 5000).replace("\n", "") + (" " + shared if i < 2 else ""), "s") for i in range(20)]
    saved, save = {}, paragraph_minhash.save

    def kept(df, name):
        out = save(df, name)
        saved[name] = out.count()
        return out

    monkeypatch.setattr(paragraph_minhash, "save", kept)
    out = paragraph_minhash.repeated_passages(table(spark, rows)).collect()
    assert {r["doc_id"] for r in out} == {0, 1} and [r["removed"] for r in sorted(out, key=lambda r: r["doc_id"])] == [False, True]
    assert saved["units"] == 20 and saved["unit-places"] < 60


def test_sizes_of_sets_with_repeats():
    rng = np.random.default_rng(9)
    g = rng.integers(0, 1 << 62, 4000, np.uint64)
    g[rng.integers(0, 4000, 1500)] = g[rng.integers(0, 4000, 1500)]
    g[:6] = np.array([1, 2, 1, 2, 3, 1], np.uint64)  # of one slot
    begin = np.concatenate(([0, 2], rng.integers(0, 3900, 300)))
    end = np.minimum(np.concatenate(([6, 5], begin[2:] + rng.integers(1, 200, 300))), 4000)
    zero = np.zeros(len(begin), np.int64)
    units = paragraph_minhash.Units(zero, begin, end - begin, zero + 1, begin, end, g)
    assert units.distinct().tolist() == [len(s) for s in units.sets()]


def test_runs_move_as_prefix_and_suffix(spark):
    """What is shuffled to count runs has two keys and a count; keys of runs agree with those of texts."""
    docs = spark.createDataFrame([("a b c a b d a b c a b c",), ("a b c",)], "text string")
    words = suffix_tree_lm.counted_words(docs)
    member = common.Membership(words, "key")
    rows = suffix_tree_lm.counted_runs(docs, 1, member, member)
    got = {r["key"]: (r["prefix"], r["suffix"], r["c"]) for r in rows.collect()}
    h, _ = suffix_tree_lm.tokens_of(["a b c"])
    w, pairs = suffix_tree_lm.runs(h, 1).tolist(), suffix_tree_lm.runs(h, 2).tolist()
    assert got == {pairs[0]: (w[0], w[1], 5), pairs[1]: (w[1], w[2], 4)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan.split("Aggregate [")[1].split("]")[0].split(", ")) == 2


def test_runs_are_summed_before_they_leave_a_slot(spark, monkeypatch):
    """Of many runs seen once few rows are made, and a task that holds few passes on what it has without losing counts."""
    docs = spark.createDataFrame([(" ".join(f"w{i * 7 % 1000} x{i}" for i in range(3000)) + " a b a b a b",)], "text string")
    rows = {(r["prefix"], r["suffix"]): r["c"] for r in suffix_tree_lm.counted_runs(docs, 1, words=True).collect()}
    h, _ = suffix_tree_lm.tokens_of(["a b"])
    a, b, _ = suffix_tree_lm.runs(h, 1).tolist()
    assert {k: c for k, c in rows.items() if k[1] != suffix_tree_lm.ALONE} == {(a, b): 3}
    assert rows[a, suffix_tree_lm.ALONE] == 3 and len(rows) == 1 + 1000 + 3000 + 3
    monkeypatch.setattr(suffix_tree_lm, "_BUFFER", 100)
    assert {(r["prefix"], r["suffix"]): r["c"] for r in suffix_tree_lm.counted_runs(docs, 1, words=True).collect()} == rows


def test_scoring_moves_rarer_runs_packed(spark, monkeypatch):
    """No join makes a row for each rarer run of a text."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 50}" for j in range(60))) for i in range(40)], "doc_id long, text string")
    monkeypatch.setattr(suffix_tree_lm, "SHARE", 0.5)
    plans = []

    def kept(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return common.save(df, name)

    monkeypatch.setattr(suffix_tree_lm, "save", kept)
    assert suffix_tree_lm.score(docs).count() == 40
    assert not hasattr(suffix_tree_lm, "lookup") and [("Join" in p) for name, p in plans if name == "lm-scores"] == [False]
