"""Hard negatives, the prefix trie and packing against plain versions in Python, on tables with odd rows."""

import collections
import hashlib
import math
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curatrix.llm import hard_negatives, packing, prefix_trie

VECTORS = "vec_id long, embedding array<float>, label int, score long, shard string, pos string, v string, want string, anchor_id string"
TURNS = "conv_id long, turn long, role string, text string, p string, key string, size string, n string, weight string, parent string"
DOCS = "doc_id long, text string, start string, length string, ids string, sequence_id string, offset string, doc_tokens string"
EXTRA = ("x",) * 6


def mined(rows, positives=5, negatives=3):
    """All pairs, row by row."""
    best = {}
    for vec_id, e, label in rows:
        if None not in (vec_id, e, label) and all(x is not None and math.isfinite(x) for x in e):
            mine = (label, [float(np.float32(x)) for x in e])
            best[vec_id] = min(best.get(vec_id, mine), mine)
    have = {i: (label, [math.floor(256 * x) for x in e]) for i, (label, e) in best.items()}
    out = set()
    for a, (label, v) in have.items():
        if a % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for i, (_, w) in have.items() if i != a and len(w) == len(v))
            for s, i in [x for x in scored if have[x[1]][0] == label][:positives]:
                fit = [(n, j) for n, j in scored if have[j][0] != label and 50 * -s <= 100 * -n <= 95 * -s][:negatives]
                out |= {(a, i, rank, j, -s, -n) for rank, (n, j) in enumerate(fit, 1)}
    return out


def found(spark, rows):
    df = spark.createDataFrame([(i, e, label, 7, *EXTRA[:5]) for i, e, label in rows], VECTORS)
    out = hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0)
    return [(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in out.collect()]


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST", 100)  # several shards
    rng = random.Random(5)
    vector = lambda n=6: [rng.choice([rng.gauss(0, 0.4), 0.25, 0.0]) for _ in range(n)]  # noqa: E731  scores tie
    rows = [(i, vector(), rng.randrange(3)) for i in range(520)]
    rows += [(1000 + i, [0.5, 0.25, -0.5, 0.25, 0.0, 0.1], i % 2) for i in range(120)]  # one vector, many times
    rows += [(2000, None, 1), (2050, vector(), None), (None, vector(), 1), (2100, [0.1, None, 0.2, 0.3, 0.1, 0.1], 1), (2150, [float("nan")] * 6, 1), (2151, [float("inf")] * 6, 1)]
    rows += [(i, vector(2), i % 2) for i in range(3000, 3030)] + [(3100, [], 1), (3101, [], 0), (3102, [], 1)] + [rows[50], (100, vector(), 9), rows[60]]
    rng.shuffle(rows)
    got = found(spark, rows)
    assert len(got) == len(set(got)) and set(got) == mined(rows)
    assert found(spark, rows[:0]) == [] and found(spark, [(51, [1.0], 1)]) == []


def test_tree_prunes_and_loses_nothing():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 60, (20, 8))
    x = np.floor(centres[rng.integers(0, 20, 5000)] + rng.normal(0, 4, (5000, 8)))
    ids, labels = rng.permutation(5000), rng.integers(0, 2, 5000)
    order = hard_negatives.tiled(x, np.arange(6))
    assert sorted(order.tolist()) == list(range(5000))
    x, ids, labels = x[order], ids[order], labels[order]
    low, high = np.full((40, 2), 1000), np.full((40, 2), 9000)
    low[:, 1], high[:, 1] = 5000, 6000
    slot, score, hit = hard_negatives.search(x, ids, labels, x[:40], ids[:40], labels[:40], low, high, False, 3)
    for a in range(40):
        s = x @ x[a]
        for w in range(2):
            want = sorted((-s[i], ids[i]) for i in np.flatnonzero((labels != labels[a]) & (s >= low[a, w]) & (s <= high[a, w])))[:3]
            assert [(-b, c) for b, c in zip(score[slot == 2 * a + w], hit[slot == 2 * a + w], strict=True)] == want
    boxes, read = hard_negatives.Tree(x).levels, 0
    for a in range(40):
        up, down = np.maximum(x[a], 0)[None, :], np.minimum(x[a], 0)[None, :]
        least, most = hard_negatives._bounds(*boxes[0], up, down)
        s = (x @ x[a]).reshape(-1)
        for leaf in range(len(boxes[0][0])):
            own = s[leaf * hard_negatives.LEAF : (leaf + 1) * hard_negatives.LEAF]
            assert least[0, leaf] <= own.min() and own.max() <= most[0, leaf]
        read += (most[0] >= 1000).sum()
    assert read < 0.8 * 40 * len(boxes[0][0])


def trie_of(rows):
    """Each prefix of each rebuilt conversation in a dictionary."""
    turns = collections.defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(own):
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
        whole = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    out = set()
    for k, cs in members.items():
        below = [x for x in members if x[: len(k)] == k]
        children = lambda n: sum(len(x) == len(n) + 1 and x[: len(n)] == n for x in members)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        digest = hashlib.sha256(",".join(map(str, ends.get(k, []))).encode()).hexdigest()
        out.add((cs[0], len(k), members[k[:-1]][0] if k else None, len(cs), children(k), sum(children(x) == 0 for x in below), saved, digest))
    return out


def nodes(spark, rows):
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], TURNS)
    out = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.hashed(df)))
    return [(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in out.collect()]


def test_prefix_trie(spark):
    rng, rows = random.Random(4), []
    for c in [*range(0, 40), *range(100, 130), *range(205, 215), -3, -105, -100]:
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc"])) for t in range(rng.randrange(1, 9))]
    rows += [(c, t, "user", "same") for c in range(40, 60) for t in range(3)]  # equal conversations
    rows += [(60, None, None, None), (60, 1, "user", None), (60, 1, "user", None), (61, None, "user", "😀"), (None, 1, "user", "lost"), (62, 0, "user", "x" * 100_000)]
    rng.shuffle(rows)
    got = nodes(spark, rows)
    assert len(got) == len(set(got)) and set(got) == trie_of(rows)
    assert nodes(spark, []) == [] and nodes(spark, [(None, 1, "a", "b")]) == []


def test_long_conversation_runs_over_partitions(spark):
    rows = [(300, t, "user", str(t % 7)) for t in range(900)] + [(301, t, "user", str(t % 7)) for t in range(900)] + [(302, 0, "user", "0")]
    assert set(nodes(spark, rows)) == trie_of(rows)


def test_turnless_conversations(spark):
    lonely = [c for c in range(901, 960) if zlib.crc32(str(c).encode()) % 6 > 1][:3]  # no conversation 900 to begin with
    rows = [(c, 0, "user", "gone") for c in lonely]
    assert set(nodes(spark, rows)) == trie_of(rows) and len(nodes(spark, rows)) == 1


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def reference(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|endoftext|", " ", "  ", "\n", " ", "  ", "'s", "it's", "é", "中文", "12,3", "\x1c", "\u0085", "\r\n"]), st.text(max_size=6))).map("".join))
def test_ids_are_the_tokenizers(text):
    tokenizer = test_ids_are_the_tokenizers.__dict__.setdefault("t", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    text = text.encode("utf-8", "replace").decode()
    assert array("I", b"".join(packing.encoded(text, "byte_bpe_50k.tiktoken"))).tolist() == reference(tokenizer, text)
    assert "".join(packing.segments(text, 3)) == text and [i for part in packing.segments(text, 3) for i in reference(tokenizer, part)] == reference(tokenizer, text) or "<|" in text


def test_differencing():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 5), (40, 7), (200, 16)):
        sizes = rng.integers(1, 100, n)
        sums, slot = packing.differencing(sizes, m)
        assert sorted(np.bincount(slot, weights=sizes, minlength=m)) == sums.tolist() and (np.diff(sums) >= 0).all()
    sums, _ = packing.differencing(rng.integers(1, 129, 600), 64)
    assert sums[-1] - sums[0] <= 8  # near-equal
    assert packing.windows_of(np.array([7, 7, 7]), 10).max() == 2  # 21 would fit into 3 windows of 10 by sum, not into fewer than 3
    assert len(set(packing.windows_of(np.array([6, 6, 6, 6]), 10).tolist())) == 4  # the count rises from 3


def test_packing(spark, tokenizer):
    rng = random.Random(6)
    word = lambda: rng.choice(["the ", "of\n", "ñandú ", "x" * 40, "  ", "12 "])
    rows = [(i, "".join(word() for _ in range(rng.choice([1, 5, 60, 900])))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, "no id"), (202, "a<|endoftext|>b"), (203, "long " * 90_000), (204, "y" * 30_000), rows[7], rows[7]]
    df = spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], DOCS)
    pieces = packing.packed(df, window=256, batch=8)
    got = [r.asDict() for r in pieces.collect()]
    docs, filled = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert r["length"] * 4 == len(r["ids"]) and r["length"] > 0
        docs[r["doc_id"]].append((r["start"], r["doc_tokens"], array("I", r["ids"]).tolist()))
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    copies = collections.Counter(i for i, _ in rows)
    for i, t in dict(rows).items():
        ids, parts = reference(tokenizer, t) + [0], sorted(docs.pop(i), key=lambda x: x[0])
        assert {n for _, n, _ in parts} == {len(ids)}
        again = [part for start, _, part in parts for _ in [0] if ids[start : start + len(part)] == part]
        assert len(again) == len(parts) and sum(map(len, again)) == copies[i] * len(ids)
    assert not docs
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    padding = sum(256 - sum(n for _, n in parts) for parts in filled.values())
    assert padding < 0.04 * sum(r["length"] for r in got)
    whole = {r["sequence_id"]: r for r in packing.sequences(pieces).collect()}
    assert sum(r["n_tokens"] for r in whole.values()) == sum(len(r["ids"]) // 4 for r in whole.values()) == sum(r["length"] for r in got)
    assert packing.packed(df.limit(0)).count() == 0
