"""Each operator against a plain version in Python on small tables, and on tables with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from curatrix.llm import decontamination, jaccard_join, line_crf, line_dedup, ordinal_classifier, paragraph_minhash, skip_chain_pii, source_mixing, suffix_tree_lm, warc
from curatrix.llm.common import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, d long, kept double, gone string, _hash string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + ("\n" if rng.random() < 0.08 else "") for _ in range(n))


def near(rng, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
    return " ".join(w)


def table(spark, rows):
    """Rows (doc_id, text, source) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "extra", 7, 0.5, "g", "h") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    """Random texts, exact and near copies, and odd rows."""
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.choice([3, 12, 60, 150, 300])), f"s{i % 12}") for i in range(120)]
    for k in range(40):
        i, t, _ = rows[rng.randrange(100)]
        rows.append((200 + k, t if k % 3 == 0 else near(rng, t, rng.choice([1, 2, 6])), f"s{k % 5}"))
    rows += [(300, None, "s1"), (301, "", None), (302, " \n\t ", "s2"), (303, rows[50][1], "s3"), (303, rows[50][1], "s3"), (None, rows[5][1], "s4"), (304, "One TWO three", "s1"), (305, "one two three", None), (306, prose(rng, 6000), "s0")]
    return rows


EMPTY_OK = [
    lambda d, e: paragraph_minhash.repeated_passages(d), lambda d, e: paragraph_minhash.remove_passages(d), lambda d, e: suffix_tree_lm.score(d), lambda d, e: skip_chain_pii.find_personal_data(d), lambda d, e: ordinal_classifier.grade_documents(d, e),
    lambda d, e: decontamination.find_leaks(d, d.select(F.col("doc_id").alias("item_id"), "text")), lambda d, e: source_mixing.mix(d), lambda d, e: line_crf.quality_rules(d, e), lambda d, e: jaccard_join.jaccard_components(d), lambda d, e: line_dedup.remove_lines(d),
]


@pytest.mark.parametrize("n", range(len(EMPTY_OK)))
def test_empty_table(spark, n):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert EMPTY_OK[n](table(spark, []), labels).collect() == []


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(1, 50)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e} | {x: find(x) for x in got}


# 1


def test_repeated_passages(spark):
    rng = random.Random(9)
    passage = prose(rng, 51, 5000)
    rows = [(i, prose(rng, 200, 5000), "s") for i in range(40)]
    for i in (3, 11, 27):
        w = rows[i][1].split(" ")
        rows[i] = (i, " ".join([*w[:70], passage, *w[70:]]), "s")
    within = prose(rng, 60, 5000)
    rows += [(50, within + " " + within, "s"), (51, None, "s"), (52, "", "s"), (53, "short text", "s"), (54, "short text", "s"), (None, rows[5][1], "s"), (60, rows[8][1], "s"), (60, rows[8][1], "s")]
    docs = table(spark, rows)
    got = collections.defaultdict(list)
    for r in paragraph_minhash.repeated_passages(docs).collect():
        got[r["doc_id"]].append((r["start_word"], r["end_word"], r["component_id"], r["removed"]))
    assert set(got) == {3, 11, 27, 5, None, 8, 60}
    for i in (3, 11, 27):
        (a, b, c, removed) = got[i][0]
        assert 70 <= a < b <= 121 and c == 3 and removed == (i != 3)
    assert not got[5][0][3] and got[None][0][3] and got[8][0][2] == 8 and got[60][0][3]
    cut = {r["doc_id"]: r for r in paragraph_minhash.remove_passages(docs).collect()}
    assert cut[3]["text"] == rows[3][1] and len(cut[11]["text"].split()) < 250 and cut[11]["text"].startswith(rows[11][1][:100]) and cut[51]["text"] is None and cut[60]["text"].strip() in rows[8][1]
    assert paragraph_minhash.remove_passages(docs).columns == docs.columns


def test_minhash_recall(spark):
    """Near copies of units collide and link as their exact similarity says."""
    rng = random.Random(4)
    rows, pairs = [], 0
    for k in range(60):
        t = [f"v{rng.randrange(10**6)}" for _ in range(32)]
        other = list(t)
        other[0 if k % 2 else 31] = "changed"  # one word at an end: 27 of 29 shingles stay
        rows += [(2 * k, " ".join(t), "s"), (2 * k + 1, " ".join(other), "s")]
        pairs += 1
    found = {r["doc_id"] for r in paragraph_minhash.repeated_passages(table(spark, rows)).collect()}
    assert sum(2 * k in found and 2 * k + 1 in found for k in range(60)) >= 0.9 * pairs


def test_changes_inside_paragraphs(spark):
    """Near copies at a similarity of 0.8 or more are found as a whole, changed words and all."""
    rng = random.Random(18)
    text = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    rows, changed = [], {}
    for k in range(60):
        n, at = ((50, [24]), (120, [20, 70]), (32, [2]))[k % 3]
        line = text(n)
        other = [f"x{k}" if j in at else w for j, w in enumerate(line)]
        for i, (x, m) in enumerate(((line, 20), (other, 10))):
            rows.append((2 * k + i, "\n".join(" ".join(y) for y in (text(m), x, text(15))), "s"))
            changed[2 * k + i] = [m + j for j in at]
    for k in range(100, 130):  # in unbroken text
        line, at = text(200), [40, 85, 130, 175]
        other = [f"x{k}" if j in at else w for j, w in enumerate(line)]
        for i, x in enumerate((line, other)):
            rows.append((2 * k + i, " ".join([*text(90), *x, *text(70)]), "s"))
            changed[2 * k + i] = [90 + j for j in at[1:3]]
    spans = collections.defaultdict(list)
    for r in paragraph_minhash.repeated_passages(table(spark, rows)).collect():
        spans[r["doc_id"]].append((r["start_word"], r["end_word"]))
    held = {i: all(any(a <= j < b for a, b in spans[i]) for j in js) for i, js in changed.items()}
    lines, unbroken = [h for i, h in held.items() if i < 200], [h for i, h in held.items() if i >= 200]
    assert sum(lines) >= 0.97 * len(lines) and sum(unbroken) >= 0.8 * len(unbroken)


def test_variant_beside_a_shared_paragraph(spark):
    """A variant that stands in one document only meets the unit that this one shares with another of the same task."""
    rng = random.Random(19)
    text = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(20):
        line = text(50)
        variant = [*line[:24], "changed", *line[25:]]
        rows += [(2 * k, "\n".join(" ".join(x) for x in (line, text(15), variant, text(15))), "s"), (2 * k + 1, "\n".join(" ".join(x) for x in (text(15), line)), "s")]
    spans = [(r["doc_id"], r["start_word"], r["end_word"]) for r in paragraph_minhash.repeated_passages(table(spark, rows).coalesce(1)).collect()]
    assert {i for i, a, b in spans if i % 2 == 0 and a <= 89 < b} == set(range(0, 40, 2))


# 2


def plain_tree(train):
    """The suffix tree by dictionaries, with the module's thresholds: (probability of a word after a text's start, counts, N, contexts)."""
    m = suffix_tree_lm
    c = collections.Counter(t for text in train for t in text)
    n, v = sum(c.values()), len(c)
    grams = [collections.Counter(tuple(text[i : i + k]) for text in train for i in range(len(text) - k + 1)) for k in range(m.DEPTH + 2)]
    kept, mass = {}, {}  # by context: the next words it keeps, and the parent's share

    def p(s, w):
        """In the state s, a retained context or ()."""
        if not s:
            return (c[w] + 0.5) / (n + 0.5 * (v + 1))
        return kept[s].get(w, 0) / (grams[len(s)][s] + m.ALPHA) + mass[s] * p(s[1:], w)

    tried, retained = {s for s, k in grams[1].items() if k >= m.LEAST}, {()}
    for length in range(1, m.DEPTH + 1):
        following = collections.defaultdict(dict)
        for g, k in grams[length + 1].items():
            if k >= m.LEAST and g[:-1] in tried:
                following[g[:-1]][g[-1]] = k
        new = set()
        for s, next_words in following.items():
            kept[s], mass[s] = next_words, (grams[length][s] - sum(next_words.values()) + m.ALPHA) / (grams[length][s] + m.ALPHA)
            x, y = [p(s, w) for w in next_words], [p(s[1:], w) for w in next_words]
            rest = [max(1 - sum(z), 1e-12) for z in (x, y)]
            if grams[length][s] * (sum(i * math.log(i / j) for i, j in zip(x, y)) + rest[0] * math.log(rest[0] / rest[1])) >= m.DIVERGENCE:
                new.add(s)
        retained |= new
        tried = {(*s, w) for s in following for w in following[s] if (*s, w)[1:] in new}

    def after(start, w):
        return p(next(s for k in range(m.DEPTH, -1, -1) if k <= len(start) and (s := tuple(start[len(start) - k :])) in retained), w)

    return after, c, n, retained


def test_suffix_tree(spark, corpus):
    rng = random.Random(8)
    phrases = [[f"p{rng.randrange(6)}" for _ in range(10)] for _ in range(6)]
    corpus = [*corpus, *((1000 + i, " ".join(w for _ in range(6) for w in rng.choice(phrases)[rng.randrange(4) :]), "s") for i in range(60))]
    rows = {(r["doc_id"], r["n_tokens"]): r for r in suffix_tree_lm.score(table(spark, corpus)).collect()}
    texts = [(i, [*words(t), None]) for i, t, _ in corpus]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    p, c, n, retained = plain_tree([t for i, t in texts if not held(i)])
    assert {1, 2, 3} <= {len(s) for s in retained}
    for i, t in texts:
        r = rows[i, len(t)]
        assert r["held_out"] == held(i) and r["train_tokens"] == n and r["n_known"] == sum(c[w] > 0 for w in t)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (len(c) + 1))) for w in t), rel=1e-9)
        assert r["score"] == pytest.approx(sum(math.log10(p(t[:k], w)) for k, w in enumerate(t)), rel=1e-6)


def test_suffix_tree_rarer_runs(spark, corpus, monkeypatch):
    """Runs that are joined add what runs sent to the tasks add."""
    rows = lambda: sorted(suffix_tree_lm.score(table(spark, corpus)).select("n_tokens", "n_known", F.round("base_score", 6), F.round("score", 6)).collect())
    sent = rows()
    monkeypatch.setattr(suffix_tree_lm, "SHARE", 0.02)
    assert rows() == sent


def test_suffix_tree_helps(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a b c", "a b d", "x y z"]) for _ in range(60)), "s") for i in range(100)]
    out = [r for r in suffix_tree_lm.score(table(spark, rows)).collect() if r["held_out"]]
    assert sum(r["score"] for r in out) > 0.7 * sum(r["base_score"] for r in out)


# 3


def plain_spans(t):
    t, digits = t or "", lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and skip_chain_pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_fuzz():
    rng = random.Random(5)
    parts = ["a", ".", "@", "-", "1", "2", "255", "999", " ", "+", "(", ")", "é", "4111111111111111", "x.y", "1.2.3.4", "😀", "%", "_"]
    for _ in range(20000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert skip_chain_pii.base_spans(t) == plain_spans(t), t


@pytest.mark.parametrize("t", ["1" * 200000, "a" * 200000 + "@", "+1" + " (" * 100000, "a@" * 100000, "1." * 100000, "a@b." * 50000])
def test_base_spans_long(t):
    skip_chain_pii.find(skip_chain_pii.fit([]), t)


def test_personal_data(spark):
    rng = random.Random(6)
    card, phone, mail = "4111 1111 1111 1111", "+1 (212) 555-1234", "jo.doe@mail.example.com"
    rows = [(i, f"{prose(rng, 20)} {card} and {phone} or {mail} from 10.0.0.{i} {prose(rng, 10)}", "s") for i in range(60)]
    rows += [(100, f"call {phone} {prose(rng, 30)} again 212.555.1234 now", "s"), (101, f"write {mail} {prose(rng, 30)} or jo.doe (at) mail.example.com", "s"), (102, "order 1234567890123456 of 555-1234", "s"), (103, None, "s"), (104, "", "s"), (None, card, "s")]
    out = {r["doc_id"]: r for r in skip_chain_pii.find_personal_data(table(spark, rows)).collect()}
    for i, t, _ in rows:
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(t))
        assert out[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(out[i]["spans"].split(","))
    assert out[100]["n_added"] == 1 and out[101]["n_added"] == 1 and "phone" in out[100]["spans"].rsplit(",", 1)[-1]
    assert out[102]["spans"] == "" and sum(r["n_added"] for i, r in out.items() if i not in (100, 101)) == 0
    assert skip_chain_pii.mask(rows[60][1], out[100]["spans"]).count("[phone]") == 2 and skip_chain_pii.mask(None, "") is None


def test_skip_edges_decide(spark):
    """A loose repeat is found by its skip edge alone, a run that holds two mentions by the field's nodes."""
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = [f"call +1 ({digits(3)}) {digits(3)}-{digits(4)} or write u{digits(5)}@mail{digits(2)}.example.com from 10.{rng.randrange(256)}.0.1 {prose(rng, 9)} no. {digits(10)}" for _ in range(300)]
    told = [(t, skip_chain_pii.mentions(t, skip_chain_pii.base_spans(t))) for t in texts]
    field = skip_chain_pii.fit([f for _, f in told] + [skip_chain_pii.with_hidden(t, f) for t, f in told])
    assert all(field.skip[k, k] > 1 for k in (1, 2, 4))
    text = "call +1 (212) 555-1234 and later 212.555.1234 but not 212.777.4321"
    at = text.index("212.555")
    assert skip_chain_pii.find(field, text)[1] == [("phone", at, at + 12)]
    assert skip_chain_pii.find(field._replace(skip=0 * field.skip), text)[1] == []
    both = "+1 (689) 555-1019 4472194062177086"
    assert skip_chain_pii.find(field, both)[0] == [] and ("phone", 0, 17) in skip_chain_pii.find(field, both)[1]


def test_loopy_marginals():
    """As by enumeration where the edges make a tree."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)
    found = [skip_chain_pii.Mention(10 * i, 10 * i + 5, 0, True, (f"k{k}",), tuple(rng.normal(size=skip_chain_pii.FEATURES))) for i, k in enumerate((1, 2, 1, 3))]
    skip, zero = rng.normal(size=(5, 5)), np.zeros((5, 5))
    for field in (skip_chain_pii.Field(rng.normal(size=(10, 5)), zero, skip + skip.T), skip_chain_pii.Field(rng.normal(size=(10, 5)), rng.normal(size=(5, 5)), zero)):
        score, want = np.array([m.features for m in found]) @ field.node, np.zeros((4, 5))
        for y in itertools.product(range(5), repeat=4):
            w = math.exp(sum(score[i, k] for i, k in enumerate(y)) + sum(field.chain[a, b] for a, b in itertools.pairwise(y)) + field.skip[y[0], y[2]])
            want[range(4), y] += w
        assert np.abs(skip_chain_pii.marginals(field, found) - want / want.sum(1, keepdims=True)).max() < 1e-3


# 4


def test_ordinal_classifier(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        kind = i % 10
        t = prose(rng, rng.randint(20, 120))
        if kind == 0:
            t = " ".join(w.upper() + "!!" for w in t.split(" "))
        elif kind == 1:
            w = t.split(" ")
            w[3:3] = [rng.choice(["vile", "nasty"]), rng.choice(["vile", "nasty"])]
            t = " ".join(w)
        rows.append((i, t, "s"))
        if i < 450:
            labels.append((i, int(kind != 0), int(kind == 1)))
    rows += [(700, None, "s"), (701, "", "s"), (None, rows[5][1], "s")]
    docs, lab = table(spark, rows), spark.createDataFrame(labels + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    graded = ordinal_classifier.grade_documents(docs, lab)
    assert graded.columns == [*docs.columns, "expected_grade", "p_good", "p_top", "kept_"]  # the table has a column "kept" of its own
    out = {r["doc_id"]: r[-4:] for r in graded.collect()}
    right = [out[i][3] == (i % 10 > 1) for i in range(450, 600)]
    assert sum(right) >= 0.97 * len(right)
    assert all(0 <= top <= good <= 1 and grade == good + top for grade, good, top, _ in out.values())
    kept = ordinal_classifier.good_documents(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(r[3] for r in out.values())
    assert {r[-1] for r in ordinal_classifier.grade_documents(docs, lab.limit(0)).collect()} == {True}


# 5


def test_warc(spark, tmp_path):
    rng = random.Random(8)
    big = ["<p>" + prose(rng, 400) for _ in range(5)]
    rows = [(i, f"http://a/{i}", rng.choice(big) if i % 3 else prose(rng, rng.randint(0, 80))) for i in range(200)]
    rows += [(500, "http://a/\r\nx", None), (501, None, ""), (None, "http://n", big[0]), (502, "é", "é" * 600), (502, "é", "é" * 600)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, part int")
    shas = []
    for n in (1, 7):
        folder = f"file://{tmp_path}/w{n}"
        (tmp_path / f"w{n}").mkdir()
        (tmp_path / f"w{n}" / "part-00000000.warc.gz.lost.tmp").write_bytes(b"half a fi")
        done = warc.write_warc(pages.repartition(n), folder, roll_bytes=20_000)
        shas.append(sorted((r["file"], r["sha1"], r["records"]) for r in done.collect()))
        (tmp_path / f"w{n}" / "part-99999999.warc.gz").write_bytes(b"left over by a lost attempt")
        got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, folder).collect())
    assert shas[0] == shas[1] and len(shas[0]) > 3
    assert not list(tmp_path.glob("w*/*.tmp"))
    keeper = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            keeper[h] = max(i, keeper.get(h, i))
    want = collections.Counter()
    for i, _, h in rows:
        b, k = (h or "").encode(), keeper.get(h)
        want[i, len(b), hashlib.sha1(b).hexdigest(), "response" if k in (None, i) else "revisit", k if k not in (None, i) else None] += 1
    assert got == want
    assert {r["payload"].decode() for r in warc.read_warc(spark, folder).where("record_type = 'response'").collect()} >= set(big)
    import gzip

    assert gzip.open(tmp_path / "w7" / "part-00000000.warc.gz").read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    empty = warc.write_warc(pages.limit(0), f"file://{tmp_path}/none")
    assert empty.count() == 0 and warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


# 6


def test_decontamination(spark, corpus):
    rng = random.Random(11)
    items = [(k, prose(rng, rng.choice([6, 15, 30, 55]), 3000)) for k in range(30)] + [(90, None), (91, "too short"), (92, "")]
    rows = []
    for k in range(60):
        w, item = prose(rng, 120, 3000).split(" "), items[rng.randrange(30)][1]
        if k % 2 == 0:
            w[40:40] = (item if k % 4 == 0 else near(rng, item, 1)).split(" ")
        rows.append((k, " ".join(w), "s"))
    rows += [(200, None, "s"), (201, "", "s"), (202, items[0][1], "s"), (202, items[0][1], "s"), (None, items[1][1].upper(), "s")]
    docs, benchmark = table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = collections.defaultdict(float)
    for r in decontamination.find_leaks(docs, benchmark).collect():
        got[r["doc_id"], r["item_id"]] = max(got[r["doc_id"], r["item_id"]], r["similarity"])
    sets = {k: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] for k, t in items if len(w := words(t)) >= 5}
    holders = collections.Counter(g for s in sets.values() for g in set(s))
    weight = lambda g: math.log1p(len(sets) / holders.get(g, 1) if g in holders else len(sets))
    want = {}
    for i, t, _ in rows:
        w = words(t)
        g = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        for k, s in sets.items():
            for j in range(len(g) - len(s) + 1):
                a, b = collections.Counter(g[j : j + len(s)]), collections.Counter(s)
                how = sum(weight(x) * min(a[x], b[x]) for x in a | b) / sum(weight(x) * max(a[x], b[x]) for x in a | b)
                if how >= 0.8 - 1e-12:
                    want[i, k] = max(how, want.get((i, k), 0))
    assert set(got) <= set(want) and all(got[x] == pytest.approx(want[x]) for x in got)
    assert len(got) >= 0.95 * len(want) and all(x in got for x, how in want.items() if how > 0.999)
    kept = decontamination.clean_documents(docs, benchmark)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _, _ in rows} - {i for i, _ in got}
    assert decontamination.clean_documents(docs, benchmark.limit(0)).count() == len(rows)


def test_blocks_of_items_agree(spark, monkeypatch):
    """Results don't depend on which items share a block: shingles weigh by the whole benchmark."""
    rng = random.Random(20)
    common = [prose(rng, 12, 3000) for _ in range(4)]
    items = [(k, f"{common[k % 4]} {prose(rng, 24, 3000)}") for k in range(40)] + [(90, None), (91, "too short"), (92, "")]
    rows = []
    for k in range(160):
        item = items[k % 40][1].split(" ")
        start = k // 40 * 3  # less and less of the common part, or other common words
        leak = [f"z{k}"] * start + item[start:] if k % 3 else common[(k + 1) % 4].split(" ")[:start] + item[start:]
        rows.append((k, " ".join([prose(rng, 30, 3000), *leak, prose(rng, 30, 3000)]), "s"))
    docs, benchmark = table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted((r["doc_id"], r["item_id"], r["start_word"], r["distance"], round(r["similarity"], 9)) for r in decontamination.find_leaks(docs, benchmark).collect())
    whole, kept = found(), sorted(r["doc_id"] for r in decontamination.clean_documents(docs, benchmark).collect())
    assert 40 < len(whole) < 160
    monkeypatch.setattr(decontamination, "ITEMS_A_BLOCK", 9)
    assert found() == whole and sorted(r["doc_id"] for r in decontamination.clean_documents(docs, benchmark).collect()) == kept


def test_multi_index_guarantee():
    """Every item fingerprint within the radius of a window is found."""
    rng = random.Random(12)
    b = decontamination.Benchmark([(k, prose(rng, 12, 5000)) for k in range(300)])
    for _ in range(200):
        n = rng.randrange(300)
        f = b.print[n]
        for bit in rng.sample(range(64), rng.randint(0, decontamination.RADIUS)):
            f ^= 1 << bit
        size = len(b.shingles[n])
        assert [x for x, _ in b.within(size, f)] == [x for x in range(300) if (b.print[x] ^ f).bit_count() <= decontamination.RADIUS and len(b.shingles[x]) == size]


# 7


def test_mixing(spark, corpus):
    rows = [(i, t, s) for i, t, s in corpus]
    out = source_mixing.mix(table(spark, rows)).collect()
    assert collections.Counter(out) == collections.Counter(source_mixing.mix(table(spark, rows[::-1]).repartition(7)).collect())
    size = lambda t: len(WORD.findall(t or ""))
    assert sorted(r["size"] for r in out) == sorted(size(t) for _, t, _ in rows)
    total = sum(r["size"] for r in out)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), total
    while True:  # what is above its cap stops there; the rest is shared again
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        capped = {s for s in free if share[s] > 3 * sizes[s]}
        if not capped:
            target |= share
            break
        target |= {s: 3 * sizes[s] for s in capped}
        free -= capped
        left = total - sum(target.values())
    by_size = {v: s for s, v in sizes.items()}
    taken = collections.Counter()
    for r in out:
        assert r["target"] == pytest.approx(target[by_size[r["source_size"]]]) and r["taken"] in [k * r["size"] for k in range(4)]
        taken[by_size[r["source_size"]]] += r["taken"]
    longest = max(r["size"] for r in out)
    assert sum(taken.values()) <= total and all(abs(taken[s] - target[s]) <= 2 * longest for s in order)
    docs = table(spark, [r for r in rows if r[0] not in (303, None)])
    mixed = source_mixing.mixed_documents(docs)
    assert mixed.columns == [*docs.columns, "repeats"] and mixed.where("repeats NOT BETWEEN 1 AND 3").count() == 0


def test_mixed_rows_of_null_and_repeated_ids(spark):
    """Each row of the mix is one row of the input with its own count: none is lost or multiplied."""
    rng = random.Random(17)
    rows = [(i, prose(rng, 20 + i), "s0") for i in range(30)] + [(None, prose(rng, 31 + k), f"s{k % 2}") for k in range(6)]
    rows += [(7, prose(rng, 40), "s0"), (7, rows[7][1], "s0"), (8, prose(rng, 28), "s1"), (9, None, "s1"), (None, rows[30][1], "s0")]
    docs = table(spark, rows)
    size = lambda t: len(WORD.findall(t or ""))
    want = collections.Counter((r["doc_id"], r["size"], r["taken"] // r["size"]) for r in source_mixing.mix(docs).collect() if r["taken"])
    mixed = source_mixing.mixed_documents(docs)
    got = mixed.collect()
    assert collections.Counter((r["doc_id"], size(r["text"]), r["repeats"]) for r in got) == want
    assert not collections.Counter((r["doc_id"], r["text"], r["source"]) for r in got) - collections.Counter(rows)
    assert any(i is None for i, _, _ in want) and sum(i == 7 for i, _, _ in want) > 1
    assert collections.Counter(got) == collections.Counter(source_mixing.mixed_documents(table(spark, rows[::-1]).repartition(5)).collect())


def test_mixing_without_words(spark):
    assert [r["taken"] for r in source_mixing.mix(table(spark, [(1, None, "a"), (2, "", None)])).collect()] == [0, 0]


# 8


def test_line_quality(spark, corpus):
    rng = random.Random(13)
    junk = lambda n: "\n".join(" | ".join(f"w{rng.randrange(99)}" for _ in range(6)) for _ in range(n))
    rows = [*corpus, (400, "a b c d e f\n" * 3 + "x y #z\nq $w", "s"), *[(1000 + i, junk(12) if i % 4 == 0 else prose(rng, 90), "s") for i in range(160)]]
    labels = spark.createDataFrame([(1000 + i, int(i % 4 != 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    out = collections.defaultdict(list)
    for r in line_crf.quality_rules(table(spark, rows), labels).collect():
        out[r["doc_id"]].append(r)
    for i, t, _ in rows:
        t = t or ""
        w, seen, dup, at = WORD.findall(t), set(), 0, collections.defaultdict(list)
        for line in t.split("\n"):
            dup += bool(WORD.search(line)) and line in seen
            seen.add(line)
        for j in range(len(w) - 4):
            at[tuple(w[j : j + 5])].append(j)
        repeat = len({k for v in at.values() if len(v) > 1 for j in v for k in range(j, j + 5)})
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, repeat, len(w) < 10 or 100 * repeat > 20 * len(w))
        assert want in [tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in out[i]]
    right = [out[1000 + i][0]["kept"] == (i % 4 != 0) for i in range(120, 160)]
    assert sum(right) >= 0.95 * len(right)
    assert not any(r["kept"] and r["base_failed"] for v in out.values() for r in v)


def test_viterbi():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    field = line_crf.Field(np.zeros((1, 2)), np.zeros(line_crf.BUCKETS), rng.normal(size=(2, 2)))
    text_of = np.repeat([0, 2, 3], [1, 6, 4])
    scores = rng.normal(size=(11, 2))
    got = line_crf.viterbi(field, scores, text_of)
    for t in (0, 2, 3):
        s = scores[text_of == t]
        value = lambda y, s=s: sum(s[i, k] for i, k in enumerate(y)) + sum(field.steps[a, b] for a, b in itertools.pairwise(y))
        assert tuple(got[text_of == t]) == max(itertools.product((0, 1), repeat=len(s)), key=value)


def test_chain_marginals():
    """Forward and backward sums as by enumeration; padding doesn't count."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    sizes, steps = [1, 5, 3], rng.normal(size=(2, 2))
    s = rng.normal(size=(3, 5, 2))
    on = np.arange(5) < np.array(sizes)[:, None]
    node, edge, z = line_crf.marginals(s, steps, on)
    for i, n in enumerate(sizes):
        weight = {y: math.exp(sum(s[i, t, k] for t, k in enumerate(y)) + sum(steps[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=n)}
        total = sum(weight.values())
        assert abs(z[i] - math.log(total)) < 1e-9 and not node[i, n:].any()
        for t in range(n):
            assert abs(node[i, t, 1] - sum(w for y, w in weight.items() if y[t]) / total) < 1e-9
            if t:
                assert abs(edge[i, t - 1, 1, 0] - sum(w for y, w in weight.items() if y[t - 1] and not y[t]) / total) < 1e-9


def test_content_and_boilerplate_in_one_text(spark):
    """Lines that many texts share are boilerplate within texts of good quality, and the field finds such lines elsewhere."""
    rng = random.Random(23)
    license = [f"All rights reserved by holder number {k} of this licensed work." for k in range(4)]
    rows, first = [], {}
    for i in range(260):
        lines = [prose(rng, 25).replace("\n", " ") for _ in range(rng.randint(2, 4))]
        if i % 2:
            lines.insert(0 if i % 4 == 1 else len(lines), license[i % 4] if i < 200 else "All rights reserved by another holder of this licensed work.")
        first[i] = len(lines)
        rows.append((i, "\n".join(lines), "s"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in line_crf.quality_rules(table(spark, rows), labels).collect()}
    mixed = [0 < out[i]["content_words"] < out[i]["n_words"] for i in range(200, 260)]
    assert all(r["kept"] for r in out.values()) and [i % 2 == 1 for i in range(200, 260)] == mixed


# 9


def plain_components(rows, n, num, den):
    sets = []
    for _, t, _ in rows:
        w = words(t)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return collections.Counter((d, len(sets[i]), low.get(find(i), d)) for i, (d, _, _) in enumerate(rows))


@pytest.mark.parametrize("block", [4096, 5])
@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_jaccard_join(spark, corpus, monkeypatch, block, n, num, den):
    """Also in blocks so small that groups take several levels, and the rest is compared across blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    rng = random.Random(14)
    rows = list(corpus)
    base = prose(rng, 100).split(" ")
    for k in range(40):  # a chain of near copies: ends differ much, neighbours little
        base[rng.randrange(100)] = f"y{k}"
        rows.append((1000 + k, " ".join(base), "s"))
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(table(spark, rows), n, num, den).collect())
    assert got == plain_components(rows, n, num, den)
    kept = jaccard_join.keep_one(table(spark, rows), n, num, den)
    assert {r["doc_id"] for r in kept.collect()} >= {c for (_, _, c) in got if c is not None} and kept.columns == table(spark, []).columns


def test_parts_are_lossless():
    """Linked sets always share a signature, at any size."""
    import numpy as np

    rng = np.random.default_rng(2)
    for num, den in ((85, 100), (80, 100), (1, 1), (1, 2)):
        bounds = jaccard_join.size_classes(num, den, 1 << 20)
        for _ in range(400):
            both = int(rng.integers(1, 200))
            extra = int(both * (den - num) / num)
            a = int(rng.integers(0, extra + 1))
            pool = np.unique(rng.integers(0, 2**63, both + extra + 9).astype(np.uint64))[: both + extra]
            x, y = np.sort(pool[: both + a]), np.sort(np.concatenate((pool[:both], pool[both + a : both + extra])))
            common = len(np.intersect1d(x, y))
            if common * den >= num * (len(x) + len(y) - common):
                p, q = (jaccard_join.part_signatures(s, num, den, bounds) for s in (x, y))
                assert any(len(np.intersect1d(p[i], q[j])) for i, j in ((0, 0), (0, 1), (1, 0)))  # a key of someone's own class


# 10


def test_line_dedup(spark):
    rng = random.Random(15)
    lines = [f"line {k} of text" for k in range(60)]
    rows = [(i, "\n".join(rng.choice(lines + ["", "  "]) if rng.random() < 0.5 else f"own {i} {k}" for k in range(rng.randint(1, 12))), f"s{rng.randrange(14)}") for i in range(80)]
    rows += [(200, None, "s1"), (201, "", "s1"), (202, lines[0], None), (203, lines[0] + "\n" + lines[1], "s1"), (203, "other\n" + lines[1], "s1"), (None, lines[2], "s5"), (204, rows[0][1], "s2"), (204, rows[0][1], "s2")]
    docs = table(spark, rows)
    sites, first = collections.defaultdict(set), {}
    keyed = sorted(((i is not None, i or 0), t or "", i, s) for i, t, s in rows)
    for _, t, i, s in keyed:
        for pos, line in enumerate(t.split("\n")):
            if WORD.search(line):
                if s is not None:
                    sites[line].add(s)
    out = line_dedup.remove_lines(docs, 6)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append(r)
    boiler = {line for line, s in sites.items() if len(s) >= 6}
    assert boiler
    stays = collections.Counter()
    for i, t, _ in rows:
        texts = {r["text"] for r in got[i]}
        assert {r["n_lines"] for r in got[i]} <= {0 if u is None else len(u.split("\n")) for j, u, _ in rows if j == i}
        if t is None:
            assert texts == {None}
    for r in out.collect():
        for line in set((r["text"] or "").split("\n")) & boiler:
            stays[line] += 1
    assert all(1 <= stays[b] <= 2 for b in boiler)  # the first occurrence; twice where a row repeats wholly
    plain = [line for _, t, _ in rows for line in (t or "").split("\n") if line not in boiler]
    assert sorted(line for r in out.collect() for line in (r["text"] or "").split("\n") if line not in boiler and WORD.search(line)) == sorted(x for x in plain if WORD.search(x))
    assert line_dedup.clean_documents(docs, 6).columns == docs.columns


def test_near_threshold_is_exact(spark):
    lines = spark.createDataFrame([(k, k, f"s{j}", k * 1000 + j) for k in range(60) for j in range(k)], "h1 long, h2 long, site string, at long").select(F.struct("h1", "h2").alias("line"), "site", "at")
    for bar in (7, 30):
        assert {r["line"]["h1"] for r in line_dedup.boilerplate_lines(lines, bar).collect()} == set(range(bar, 60))
