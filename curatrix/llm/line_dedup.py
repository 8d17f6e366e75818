"""Operator 10: removal of lines that stand on many sites, by distinct-site sketches per line.

A HyperLogLog sketch of sites is merged for each line hash by aggregation. Lines surely above the threshold are
boilerplate, lines near it (within the sketch's error) get an exact distinct count. The first occurrence of a boilerplate
line (smallest id) stays, all others are removed.

Cases: a null text stays null and has 0 lines; lines without a word are left alone; a null site counts as no site. Rows
that repeat an id (or have none) with another text are told apart by the text; wholly repeated rows are treated alike. Very
long texts are hashed piece by piece. Other columns are kept, whatever their names. Only texts that lose a line move to be
joined with their marks. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, arrow_batch, lookup, read, save, span_hashes, text_chunks, with_marks, words_of

MIN_SITES = 10
LG_K = 12  # of the sketches: relative error 1.04 / sqrt(2**12)
_ERROR = 3 * 1.04 / 2 ** (LG_K / 2)


def boilerplate_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """lines (line: a struct of two hashes, site, at), saved -> (line, n, first) of those on at least min_sites sites."""
    per_line = save(lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sites"), F.count("*").alias("n"), F.min("at").alias("first")).where(F.col("n") >= min_sites), "line-sketches")
    sites = F.hll_sketch_estimate("sites")
    low, high = min_sites * (1 - _ERROR) - 1, min_sites * (1 + _ERROR) + 1
    sure = per_line.where(sites >= high).drop("sites")
    near = per_line.where((sites >= low) & (sites < high)).drop("sites")
    # Lines and sites of the near ones alone; frequent lines don't meet in one task.
    some = lookup(lines.select("line", "site"), near.select("line", "n"), "line", "n", lines.count()).where("n IS NOT NULL AND site IS NOT NULL")
    exact = some.select("line", "site").distinct().groupBy("line").agg(F.count("*").alias("c")).where(F.col("c") >= min_sites)
    return sure.unionByName(near.join(exact.select("line"), "line", "left_semi"))


def remove_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with cleaned texts, and the numbers of lines before and of lines removed in the columns `counts`."""
    text = F.col(text_col).cast("string")
    lines = docs.select(F.col(id_col).cast("long").alias("id"), F.col(site_col).cast("string").alias("site"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32()), ("site", pa.string()), ("h1", pa.int64()), ("h2", pa.int64())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "text"):
            words = words_of(texts)
            ends = np.flatnonzero(words.raw == 10)
            begins = np.concatenate(([0], ends[:-1] + 1))
            has = np.searchsorted(words.begin, ends) > np.searchsorted(words.begin, begins)
            text_of = np.searchsorted(words.text_at, begins, side="right") - 1
            pos = np.arange(len(begins)) - np.searchsorted(begins, words.text_at[:-1])[text_of]
            begins, ends, of, pos = begins[has], ends[has], text_of[has], pos[has]
            at = pa.array(of)
            yield arrow_batch(schema, [batch.column(0).take(at), batch.column(3).take(at), pos.astype(np.int32), batch.column(1).take(at), *(span_hashes(words.raw, begins, ends, seed).view(np.int64) for seed in (1, 2))])

    lines = save(lines.mapInArrow(hashed, "id long, text_hash long, pos int, site string, h1 long, h2 long"), "lines")
    lines = lines.select(F.struct("h1", "h2").alias("line"), "site", F.struct("id", "text_hash", "pos").alias("at"))
    found = save(boilerplate_lines(lines, min_sites), "boilerplate")
    hits = lookup(lines.select("line", "at"), found, "line", "n", lines.count())
    gone = hits.where("at <> first").groupBy(F.col("at.id").alias("_id"), F.col("at.text_hash").alias("_hash")).agg(F.collect_set("at.pos").alias("_gone"))
    gone = save(gone, "lines-gone")
    names, inner = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    marked = with_marks(docs.toDF(*inner), inner[names.index(id_col)], inner[names.index(text_col)], gone).select(*inner, "_gone")
    of = names.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, inner[of]):
            out, before, removed = list(texts), [], []
            for i, (text, gone) in enumerate(zip(texts, batch.column(len(inner)).to_pylist(), strict=True)):
                split = [] if text is None else text.split("\n")
                lost = gone or []
                if lost:
                    drop = set(lost)
                    out[i] = "\n".join(x for n, x in enumerate(split) if n not in drop)
                before.append(len(split))
                removed.append(len(lost))
            columns = [pa.array(out, pa.string()) if c == of else batch.column(c) for c in range(len(inner))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64()), pa.array(removed, pa.int64())], names=[*inner, "before", "removed"])

    ddl = ", ".join(f"{c} {t}" for c, t in marked.dtypes[:-1])
    return marked.mapInArrow(cut, f"{ddl}, before long, removed long").toDF(*names, *counts)


def clean_documents(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Documents with cleaned texts; those that the removal left without a word go."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    name = dict(zip(docs.columns, inner, strict=True))
    out = remove_lines(docs.toDF(*inner), min_sites, name["doc_id"], name["text"], name["source"])
    return out.where((F.col("n_removed") == 0) | F.col(name["text"]).rlike(WORD)).select(*inner).toDF(*docs.columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_lines(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT line, min(struct_pack(d := doc_id, p := pos)) AS first_at FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  GROUP BY line HAVING count(DISTINCT source) >= 10
), m AS (
  SELECT l.*, coalesce(struct_pack(d := doc_id, p := pos) <> b.first_at, false) AS gone FROM l LEFT JOIN b ON l.line = b.line
), k AS (
  SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_removed,
    md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_md5 FROM m GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.kept_md5, md5('')) AS kept_md5
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
