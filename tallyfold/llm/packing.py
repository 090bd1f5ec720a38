"""Training sequences by vector bin packing under limits on tokens, segments and loss-bearing tokens.

A sequence is filled with the example that has the largest dot product with
what the sequence still holds (dot-product heuristic, Panigrahy et al. 2011),
among those that fit in every dimension, until none does.

Every task packs its own rows, a pool of bounded size after the other, so
nothing is shuffled or gathered; a task leaves about one sequence per pool
partly empty.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .shared import map_batches

TOKENS = 1024
SEGMENTS = 64
#: examples packed together
POOL = 2048
#: sequences of one task are numbered below this
_PER_TASK = 1 << 40


def fill(needs: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Rows of ``needs`` (examples x dimensions) dealt to sequences; each fits ``limits``.

    An example that exceeds a limit by itself gets a sequence of its own.
    """
    share = needs / limits
    sequences = [[int(k)] for k in np.flatnonzero((share > 1).any(axis=1))]
    # by falling size, so equal products go to the larger example
    left = np.argsort(-share.sum(axis=1), kind="stable")
    left = left[(share[left] <= 1).all(axis=1)]
    work, whole = share[left], needs[left]
    alive = np.ones(len(left), dtype=bool)
    start = 0
    while start < len(left):
        if not alive[start]:
            start += 1
            continue
        one, rest = [], limits.astype(np.int64).copy()
        k = start
        while k >= 0:
            one.append(int(left[k]))
            alive[k] = False
            rest -= whole[k]
            fits = alive[start:] & (whole[start:] <= rest).all(axis=1)
            score = np.where(fits, work[start:] @ (rest / limits), -1.0)
            best = int(np.argmax(score))
            k = start + best if score[best] >= 0 and fits[best] else -1
        sequences.append(one)
        if start < len(left) // 2 and not alive[: len(left) // 2].any():
            keep = np.flatnonzero(alive)
            left, work, whole, alive, start = left[keep], work[keep], whole[keep], alive[keep], 0
    return sequences


def _packer(limits: np.ndarray, pool: int):
    def pack(table: pa.Table, first: int) -> tuple[pa.RecordBatch, int]:
        needs = np.stack([table.column(c).to_numpy() for c in ("length", "segments", "loss")], axis=1)
        sequences = fill(needs, limits)
        rows = np.array([r for one in sequences for r in one], dtype=np.int64)
        sizes = np.array([len(one) for one in sequences])
        number = np.repeat(np.arange(first, first + len(sequences)), sizes)
        ends = np.cumsum(needs[rows, 0])
        begin = ends - needs[rows, 0]
        heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        offset = begin - np.repeat(begin[heads], sizes)
        out = table.take(pa.array(rows)).drop_columns(["segments", "loss"])
        out = out.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))
        return out.combine_chunks().to_batches()[0], first + len(sequences)

    def run(batches):
        number = TaskContext.get().partitionId() * _PER_TASK
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, pool - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == pool:
                    out, number = pack(pa.Table.from_batches(held), number)
                    yield out
                    held, rows = [], 0
        if rows:
            out, number = pack(pa.Table.from_batches(held), number)
            yield out

    return run


def pack(
    examples: DataFrame,
    length: str = "length",
    segments: str | None = None,
    loss: str | None = None,
    max_tokens: int = TOKENS,
    max_segments: int = SEGMENTS,
    max_loss: int | None = None,
    pool: int = POOL,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (tokens before the example in its sequence, gapless from 0).

    ``segments`` (default one each) and ``loss`` (default all tokens) name further
    columns to be held under their limits. Nulls there and in ``length`` count
    as 0. An example beyond a limit by itself makes a sequence of its own. An
    empty table gives an empty one. Other columns pass through; columns called
    sequence_id or offset are replaced, segments and loss are dropped.
    """
    long = lambda c, other: F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0).cast("long")) if c else other
    kept = [c for c in examples.columns if c not in ("sequence_id", "offset", "segments", "loss", "length", length)]
    ready = examples.select(
        *[F.col(f"`{c}`") for c in kept],
        long(length, None).alias("length"),
        long(segments, F.lit(1).cast("long")).alias("segments"),
        long(loss, long(length, None)).alias("loss"),
    )
    fields = [f for f in ready.schema.fields if f.name not in ("segments", "loss")]
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    limits = np.array([max_tokens, max_segments, max_tokens if max_loss is None else max_loss])
    out = map_batches(ready, _packer(limits, pool), schema)
    return out if length == "length" else out.withColumnRenamed("length", length)


def _cut(longest: int, last_id: int, path: str, special: bool):
    def run(batches):
        for batch in batches:
            rows, start, length, crc, total = [], [], [], [], []
            for r, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(bpe.encode(text or "", path, special), np.uint32(last_id)).astype("<u4")
                for at in range(0, len(ids), longest):
                    part = ids[at : at + longest]
                    rows.append(r)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
            if rows:
                yield pa.record_batch(
                    [
                        batch.column("doc_id").take(pa.array(rows)),
                        *[pa.array(c, pa.int64()) for c in (start, length, crc, total)],
                    ],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return run


def pieces(
    df: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    longest: int = TOKENS,
    last_id: int = 0,
    path: str | None = None,
    special: bool = False,
) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, loss.

    A document is the ids of its whole text, then ``last_id``; it is cut after
    every ``longest`` ids. ``loss`` counts the ids of a piece that another id of
    the piece precedes. ``special`` as in ``bpe.encode``. A null or empty text is ``last_id`` alone. Repeated rows
    are documents each; an empty table gives none; other columns are ignored.
    """
    narrow = df.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType(
        [narrow.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]
    )
    cut = map_batches(narrow, _cut(longest, last_id, path or bpe.default_path(), special), schema)
    return cut.withColumn("loss", F.col("length") - 1)
