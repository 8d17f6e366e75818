"""Packing documents into training sequences by Karmarkar-Karp multiway differencing.

Each task packs the documents of its own partition, so nothing is shuffled, and a task that runs again packs them the same
way. A document's ids are cut into whole windows, which are full sequences by themselves, and a rest. Rests are cut into
pieces of an eighth of a window and gathered until they nearly fill a batch of windows; differencing then deals the pieces to
windows of near-equal length: it merges the two partial partitions of the largest imbalance, the longest slots of one with
the shortest of the other. Whenever a window exceeds its capacity, the count of windows rises by one and the batch is dealt
anew. A document's last piece is cut where a batch is full.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# White space as Unicode has it, the pattern of the vocabulary where no two such characters stand side by side
# (its look-ahead then decides nothing, and without it the pattern is matched in linear time), the special token and its id.
_SPACE = "\t-\r \x85\xa0  -     　"
_SINGLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_SPECIAL, _SPECIAL_ID = "<|endoftext|>", 50256

_two_spaces = re.compile(f"[{_SPACE}][{_SPACE}]").search
_word_end = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])").search
SEGMENT = 1 << 18
END = array("I", [0]).tobytes()
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


@cache
def _encodings(vocabulary: str) -> tuple[tiktoken.Encoding, tiktoken.Encoding]:
    """With the vocabulary's own pattern, and with that for single white space."""
    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    make = lambda pattern: tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return make(public_tokenizers.PATTERN), make(_SINGLE)


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """A text in parts of about `size` characters that are encoded alike apart: cut where white space begins."""
    at = 0
    while len(text) - at > size:
        found = _word_end(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def encoded(text: str, vocabulary: str) -> Iterator[bytes]:
    """The ids of a text as little-endian 32-bit numbers, part by part."""
    full, single = _encodings(vocabulary)
    for n, plain in enumerate(text.split(_SPECIAL)):
        if n:
            yield array("I", [_SPECIAL_ID]).tobytes()
        for part in segments(plain):
            yield array("I", (full if _two_spaces(part) else single).encode_ordinary(part)).tobytes()


_BITS = 32


def differencing(sizes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Deals sizes to m slots: (the slots' sums ascending, each item's slot).

    A partial partition is a sorted array of m slots, each a sum and, in the low bits, the number of its node; 0 is empty.
    """
    low, slots, merges, node = (1 << _BITS) - 1, np.arange(m), [], len(sizes) + 1
    heap = []
    for i, size in enumerate(sizes.tolist(), 1):
        one = np.zeros(m, np.int64)
        one[-1] = size << _BITS | i
        heap.append((-size, i, one))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2][::-1]
        both = ((a >> _BITS) + (b >> _BITS) << _BITS) + (slots + node)
        merges.append((a & low, b & low, node))
        both.sort()
        heapq.heappush(heap, (int(both[0] >> _BITS) - int(both[-1] >> _BITS), node, both))
        node += m
    last = heap[0][2]
    slot = np.zeros(node, np.int64)
    slot[last & low] = slots
    for a, b, first in reversed(merges):
        slot[a] = slot[b] = slot[first : first + m]
    return last >> _BITS, slot[1 : len(sizes) + 1]


def windows_of(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size, of as few windows as hold them all within the capacity, counting up from what the sum needs."""
    m = -(-int(sizes.sum()) // capacity)
    while True:
        sums, slot = differencing(sizes, m)
        if sums[-1] <= capacity:
            return slot
        m += 1


class _Packer:
    """Packs the documents of one task; rows() has the pieces that have a sequence."""

    def __init__(self, window: int, batch: int, cut: int, task: int):
        self.window, self.cut = window, cut
        self.goal = batch * (window - max(1, window // 128))
        self.next = task << 32
        self.done: list[tuple] = []
        self.open: list[tuple] = []
        self.held = 0

    def add(self, doc_id: int | None, parts: Iterator[bytes]) -> None:
        rest, start, first = b"", 0, len(self.done)
        for part in parts:
            rest += part
            whole = len(rest) // (4 * self.window)
            for i in range(whole):
                self.done.append([doc_id, start, self.window, rest[4 * self.window * i : 4 * self.window * (i + 1)], 0, self.next, 0])
                self.next += 1
                start += self.window
            rest = rest[4 * self.window * whole :]
        total, at = start + len(rest) // 4, 0
        for row in self.done[first:]:
            row[4] = total
        while at < len(rest):
            n = min(self.cut, self.goal - self.held, (len(rest) - at) // 4)
            self.open.append([doc_id, start, n, rest[at : at + 4 * n], total, 0, 0])
            self.held, start, at = self.held + n, start + n, at + 4 * n
            if self.held == self.goal:
                self.deal()

    def deal(self) -> None:
        """Deals the open pieces to windows; within a window they stay in order."""
        if not self.open:
            return
        slot = windows_of(np.array([row[2] for row in self.open]), self.window)
        filled = [0] * (int(slot.max()) + 1)
        for row, s in zip(self.open, slot.tolist(), strict=True):
            row[5], row[6] = self.next + s, filled[s]
            filled[s] += row[2]
        self.next += len(filled)
        self.done += self.open
        self.open, self.held = [], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.done:
            yield common.arrow_batch(PIECES, list(zip(*self.done, strict=True)))
            self.done = []


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 1024, batch: int = 64, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """A row for each piece of each document: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    A document is the ids of its text, as the public tokenizer of this vocabulary gives them, then id 0. The sequences that
    are gathered from rests are `batch` at a time; a task's last batch may leave one of them partly empty.

    Null and empty texts are the closing id alone. Null ids stay null, and rows that repeat are documents of their own. Very
    long texts are encoded in parts that begin with white space; a run without white space is one part. Without documents
    there are no pieces. Other columns are left out, whatever their names.
    """
    common.small_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(window, batch, max(1, window // 8), TaskContext.get().partitionId())
        for rows, texts in common.text_chunks(batches, "text"):
            for one, content in zip(rows.column(0).to_pylist(), texts, strict=True):
                packer.add(one, (part for parts in (encoded(content or "", vocabulary), [END]) for part in parts))
            yield from packer.rows()
        packer.deal()
        yield from packer.rows()

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(pack, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of packed pieces, their ids in order of the offset: at most a window in a group."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    joined = F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024: a row for each piece, with a checksum of its ids."""
    pieces = packed(common.read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
