"""Web archives with an index of byte ranges, written and read back.

Writing: every task writes its records to an archive of its own, one gzip
member per record, and returns the index: file, offset, length, URL, digest.
Reading: the index rows wanted are sorted by place, neighbouring ranges are
coalesced, and each task fetches its ranges and parses the records in them.

Archives are reached through ``pyarrow.fs``, so the folder may be any store it
opens; it must be shared, as ``spark.checkpoint.dir`` is.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from . import tokens
from .shared import map_batches, materialize

#: payloads below this are always written in full
LEAST_SHARED = 1000
#: a new archive is begun beyond this
FILE_BYTES = 256 << 20
#: ranges closer than this are read as one, up to a block
GAP_BYTES = 64 << 10
#: bytes that one task reads back
TASK_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
LEVEL = 4
#: records carry no time of their own
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

INDEX = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.StringType()),
    ]
)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    name = lambda page: uuid.uuid5(_NAMES, f"{page}:{digest}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(body)}",
    ]
    if url is not None:
        plain = re.fullmatch("[!-~]+", url)
        head.append(f"WARC-Target-URI: {url if plain else quote(url, safe='/:?#[]@!$&*+,;=')}")
        if not plain:  # what cannot stand in a header line is percent-encoded; reading takes it back
            head.append("X-Escaped-URI: yes")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:uuid:{name(refers_to)}>", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The record's headers and payload; a response's payload is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number("X-Page-Id"),
        "url": unquote(url) if "X-Escaped-URI" in fields else url,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-Id"),
        "payload": None if revisit else payload.decode(),
    }


def _zip(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _write(folder: str, file_bytes: int):
    def run(batches):
        task = TaskContext.get()
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        out, name, at, count = None, "", 0, 0
        for piece in (p for batch in batches for p in tokens.slices(batch, "html")):
            rows = []
            for r in piece.to_pylist():
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    # an attempt's files have names of their own: the index names those of the attempt that ended well
                    name = f"{task.partitionId():06d}-{count:04d}-{uuid.uuid4().hex}.warc.gz"
                    out, at, count = store.open_output_stream(f"{base}/{name}", compression=None), 0, count + 1
                payload = (r["html"] or "").encode()
                revisit = r["refers_to"] is not None
                data = _zip(record(r["page_id"], r["url"], payload, r["digest"], r["refers_to"], revisit))
                out.write(data)
                kind = "revisit" if revisit else "response"
                rows.append(
                    {"file": name, "offset": at, "length": len(data), "page_id": r["page_id"], "url": r["url"],
                     "digest": r["digest"], "record_type": kind}
                )
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_arrow(INDEX))
        if out is not None:
            out.close()

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {T.StringType(): pa.string(), T.LongType(): pa.int64()}
    return pa.schema([(f.name, kinds[f.dataType]) for f in schema.fields])


def write_archives(
    pages: DataFrame,
    folder: str,
    page: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_shared: int = LEAST_SHARED,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a record per row to archives in ``folder``; return their index (``INDEX``), itself a table there.

    Of rows with equal payloads of at least ``least_shared`` bytes, the one with
    the largest page id is written in full and the others revisit it; rows that
    tie with it are written in full, too. Null page ids are smallest; if a
    group has no other, all are written in full. A null html is an empty
    payload, a null URL is left out. An empty table gives an empty index. Other
    columns are ignored.
    """
    text = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(
        F.col(f"`{page}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.col(f"`{html}`").alias("html"),
        F.sha1(text.cast("binary")).alias("digest"),
    )
    # one row per shared payload; combined before the shuffle, so a frequent payload is a few rows
    shared = (
        pages.filter(F.octet_length(text) >= least_shared)
        .groupBy(F.sha1(text.cast("binary")).alias("digest"))
        .agg(F.max(F.col(f"`{page}`").cast("long")).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND first IS NOT NULL")
        .select(F.col("digest").alias("_shared"), "first")
    )
    # names equal payloads by digest: SHA-1 alone decides that two payloads are equal
    marked = rows.join(shared, F.col("digest") == F.col("_shared"), "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first"))
    ready = marked.select("page_id", "url", "html", "digest", refers.cast("long").alias("refers_to"))
    return materialize(map_batches(ready, _write(folder, file_bytes), INDEX), "warc-index")


def _ranges(index: DataFrame) -> DataFrame:
    """Neighbouring ranges of a file as one row: file, offset, length, parts (offset, length of each record)."""
    w = Window.partitionBy("file").orderBy("offset")
    gap = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(w)
    block = F.floor(F.col("offset") / BLOCK_BYTES)
    cut = F.coalesce((gap > GAP_BYTES) | (block != F.lag(block).over(w)), F.lit(True))
    runs = index.select("file", "offset", "length", cut.cast("int").alias("cut")).withColumn("run", F.sum("cut").over(w))
    return runs.groupBy("file", "run").agg(
        F.min("offset").alias("offset"),
        (F.max(F.col("offset") + F.col("length")) - F.min("offset")).alias("length"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("parts"),
    )


def _read(folder: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        name, source = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["file"] != name:
                    if source is not None:
                        source.close()
                    name, source = r["file"], store.open_input_file(f"{base}/{r['file']}")
                data = source.read_at(r["length"], r["offset"])
                rows = []
                for part in r["parts"]:
                    at = part["offset"] - r["offset"]
                    rows.append(parse(zlib.decompress(data[at : at + part["length"]], 31)))
                yield pa.RecordBatch.from_pylist(rows, schema=_arrow(RECORD))
        if source is not None:
            source.close()

    return run


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` names (``RECORD``), by coalesced byte ranges in order of place.

    ``index`` may be any selection of the rows that ``write_archives`` returned. A
    revisit has the size and digest of the full payload, but not the payload. The
    bytes of the ranges, counted first, decide how many tasks read them.
    """
    wanted = index.distinct()
    size = wanted.agg(F.sum("length")).first()[0] or 0
    tasks = max(size // TASK_BYTES, min(index.sparkSession.sparkContext.defaultParallelism, size // BLOCK_BYTES), 1)
    # an explicit number: the index rows are small, what they stand for is not
    wanted = _ranges(wanted).repartitionByRange(int(tasks), "file", "offset").sortWithinPartitions("file", "offset")
    return map_batches(wanted.select("file", "offset", "length", "parts"), _read(folder), RECORD)


def archive_folder(spark: SparkSession) -> str:
    """A fresh folder for archives in the cluster's shared folder."""
    return scratch_path(spark, "warc")
