"""Operator 5: a deterministic sharded WARC writer, and its reader.

Records are range-sorted by page_id and compressed one by one (once for their sizes, once more as they are written, which
costs less than moving them twice); a file's number is the compressed bytes before a record,
over all files, divided by the roll size, so files don't depend on partitions, retries or the cluster. Each file is written
under a temporary name by one task and renamed when whole; the manifest table, written last, names the files that count.
Readers follow the manifest, check sizes and digests, and see nothing of attempts that were lost; temporary files of these
are deleted when the manifest stands.

Among equal payloads of at least MIN_REVISIT bytes the record of the largest page_id is the response; the others are
revisits of it, without payload (its size and digest stand in the headers). Headers are made anew from the row alone.

Cases: a null payload is empty; a null url is an empty target; a null page_id sorts first and is read back as null (it is
never a payload's response if there are others). Repeated rows give a record each; those of a payload's largest page_id are
all responses, as a reader could not tell which of them a revisit means, and rows alike in page_id, url and payload have one
record id and share a file. Very long payloads are one record each, compressed whole. Other columns are ignored. An empty
table gives no files and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_batch, lookup, partitions_for, read, save, shared_dir

ROLL_BYTES, MIN_REVISIT, DATE = 16 << 20, 1000, "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _id(kind: str, key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{key}')}>"


def _member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as a gzip member without time or name."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))]) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def _record(page: int | None, url: str | None, payload: bytes, sha1: str, of: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if of is not None else http + payload
    headers = [
        ("WARC-Type", "response" if of is None else "revisit"), ("WARC-Record-ID", _id("page", page)), ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")), ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()), ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
    ]
    headers += [("X-Page-ID", page)] if page is not None else []
    headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _id("page", of)), ("X-Refers-To-Page-ID", of)] if of is not None else []
    return _member(headers, block)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 64):
            yield batch.slice(at, 64)


def _members(part: pa.RecordBatch) -> Iterator[bytes]:
    """Records of rows (page, url, payload, sha1, of)."""
    for page, url, text, sha1, of in zip(*(c.to_pylist() for c in part.columns), strict=True):
        yield _record(page, url, text.encode(), sha1, of if of is not None and of != page else None)


def _key(page: int | None, url: str | None, sha1: str) -> tuple:
    """Compares as Spark sorts: nulls first, texts by code point."""
    return page is not None, page or 0, url is not None, url or "", sha1


def write_warc(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes folder/*.warc.gz and folder/manifest; returns the manifest (file, records, bytes, sha1)."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    copies = rows.where(F.col("size") >= MIN_REVISIT).groupBy("sha1", "size").agg(F.max("page").alias("of"), F.count("*").alias("n")).where("n > 1").select(F.concat_ws(":", "sha1", "size").alias("key"), "of", "n")
    rows = rows.withColumn("key", F.concat_ws(":", "sha1", "size"))
    copies = save(copies, "warc-copies")
    rows = lookup(rows, copies, "key", "n", copies.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    rows = rows.select("page", "url", "payload", "sha1", "of")
    schema = pa.schema([("page", pa.int64()), ("url", pa.string()), ("sha1", pa.string()), ("bytes", pa.int64())])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _small(batches):
            yield arrow_batch(schema, [part.column(0), part.column(1), part.column(3), [len(m) for m in _members(part)]])

    # Compressed bytes before each record: sums within range partitions, and over the few partitions.
    order = ["page", "url", "sha1"]
    made = save(rows.mapInArrow(sizes, "page long, url string, sha1 string, bytes long"), "warc-sizes")
    made = save(made.repartitionByRange(partitions_for(pages), *order).withColumn("part", F.spark_partition_id()), "warc-sorted")
    before = F.coalesce(F.sum("bytes").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = made.groupBy("part").agg(F.sum("bytes").alias("total")).withColumn("start", F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("total")
    placed = made.withColumn("before", before).join(parts, "part").withColumn("file", F.floor((F.col("start") + F.col("before")) / roll_bytes))
    # A row for each file: its first key. Equal keys share the later file.
    starts = [_key(*r["first"]) for r in placed.groupBy("file").agg(F.min(F.struct(*order)).alias("first")).orderBy("file").collect()]
    sent = pages.sparkSession.sparkContext.broadcast(starts)
    filed_schema = pa.schema([("file", pa.int64()), ("page", pa.int64()), ("url", pa.string()), ("payload", pa.string()), ("sha1", pa.string()), ("of", pa.int64())])

    def file_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, url, sha1 = (batch.column(i).to_pylist() for i in (0, 1, 3))
            yield arrow_batch(filed_schema, [[bisect_right(sent.value, _key(*k)) - 1 for k in zip(page, url, sha1, strict=True)], *batch.columns])

    done_schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        number = out = None

        def finish() -> pa.RecordBatch:
            out.close()
            store.move(temporary, f"{base}/{name}")
            return arrow_batch(done_schema, [[name], [records], [size], [sha.hexdigest()]])

        for part in _small(batches):
            for file, member in zip(part.column(0).to_pylist(), _members(part.select(filed_schema.names[1:])), strict=True):
                if file != number:
                    if out:
                        yield finish()
                    number, name, records, size, sha = file, f"part-{file:08d}.warc.gz", 0, 0, hashlib.sha1()
                    temporary = f"{base}/{name}.{uuid.uuid4().hex}.tmp"
                    out = store.open_output_stream(temporary, compression=None)
                    member = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _id("file", name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n") + member
                out.write(member)
                sha.update(member)
                records, size = records + 1, size + len(member)
        if out:
            yield finish()

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    filed = rows.mapInArrow(file_of, "file long, page long, url string, payload string, sha1 string, of long")
    # Tasks get equal numbers of files in a row, as files are of about equal size; hashed numbers would heap some up.
    tasks = max(min(len(starts), partitions_for(pages)), 1)
    files = filed.repartitionById(tasks, F.floor(F.col("file") * tasks / max(len(starts), 1)).cast("int")).sortWithinPartitions("file", *order)
    files.mapInArrow(write, "file string, records long, bytes long, sha1 string").write.parquet(f"{folder}/manifest")
    for lost in store.get_file_info(fs.FileSelector(base)):
        if lost.path.endswith(".tmp"):
            store.delete_file(lost.path)
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each member of a file."""
    view, at = memoryview(content), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("a record is cut short")
            piece = view[at : at + (1 << 15)]  # small pieces: what is left over is copied
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        data = b"".join(parts)
        head, _, rest = data.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the files in the manifest: page_id, record_type, refers_to, url, payload (null for revisits), payload_bytes, payload_digest."""
    names = spark.read.parquet(f"{folder}/manifest").select("file", "bytes")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    files = content.withColumn("file", F.substring_index("path", "/", -1)).join(names, "file").select("file", "bytes", "content")
    ddl = "page_id long, record_type string, refers_to long, url string, payload binary, payload_bytes long, payload_digest string"
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(len(batch)):
                name, size, data = (batch.column(i)[n].as_py() for i in range(3))
                if len(data) != size:
                    raise ValueError(f"{name} has {len(data)} bytes, its manifest {size}")
                rows, held = [], 0
                for headers, block in _records(data):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    sha1 = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    whole = headers["WARC-Type"] == "response"
                    if whole and (len(payload) != length or hashlib.sha1(payload).hexdigest() != sha1):
                        raise ValueError(f"{name}: the payload of {headers['WARC-Record-ID']} doesn't fit its headers")
                    number = lambda k, h=headers: int(h[k]) if k in h else None
                    rows.append((number("X-Page-ID"), headers["WARC-Type"], number("X-Refers-To-Page-ID"), headers["WARC-Target-URI"], payload if whole else None, length, sha1))
                    held += len(block)
                    if held > 4 << 20:
                        yield arrow_batch(schema, [list(c) for c in zip(*rows, strict=True)])
                        rows, held = [], 0
                if rows:
                    yield arrow_batch(schema, [list(c) for c in zip(*rows, strict=True)])

    return files.mapInArrow(parse, ddl)


def op5_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/curatrix/warc-{uuid.uuid4().hex}"
    write_warc(read(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT html, max(page_id) AS keeper FROM p WHERE octet_length(encode(html)) >= 1000 GROUP BY html)
SELECT p.page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN k.keeper IS NULL OR k.keeper = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k.keeper <> p.page_id THEN k.keeper END AS refers_to
FROM p LEFT JOIN k ON p.html = k.html
"""
