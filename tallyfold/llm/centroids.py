"""Clustering of whole-number vectors around centroids, exactly, on dictionaries of subvectors.

Vectors are encoded once, in chunks: neighbouring dimensions form blocks, and
each block of a chunk is a dictionary of its distinct subvectors plus a code per
vector, without loss. Blocks grow while their subvectors repeat (copies and
sparse stretches share long entries; dense numbers end as single dimensions,
where a chunk holds far fewer values than vectors). A round computes the distance of
every dictionary entry to every centroid once, adds up a vector's distances
by its codes, and adds up a centroid's vectors by counting codes. Only k
centroids and sums per task travel; vectors are never shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import map_batches, materialize

#: vectors encoded together; codes take two bytes
CHUNK = 8192
#: a block may have one distinct subvector per so many vectors, else it is split
REPEATS = 4
#: components beyond this would overflow the squared distances
LARGEST = 1 << 27

_BLOCK = T.StructType(
    [T.StructField(n, t) for n, t in (("first", T.IntegerType()), ("width", T.IntegerType()), ("entries", T.BinaryType()), ("codes", T.BinaryType()))]
)
_BLOCK_ARROW = pa.list_(pa.struct([("first", pa.int32()), ("width", pa.int32()), ("entries", pa.binary()), ("codes", pa.binary())]))


def encode(vectors: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of the columns: (first column, distinct subvectors, code per row)."""
    rows, columns = vectors.shape
    blocks = []  # (first, end, codes, number of entries)
    for c in range(columns):
        values, codes = np.unique(vectors[:, c], return_inverse=True)
        blocks.append((c, c + 1, codes, len(values)))
    while len(blocks) > 1:
        merged, at = [], 0
        while at < len(blocks):
            one = blocks[at]
            two = blocks[at + 1] if at + 1 < len(blocks) else None
            # joined entries are no fewer than either part's
            if two is not None and REPEATS * max(one[3], two[3]) <= rows:
                values, codes = np.unique(one[2] * two[3] + two[2], return_inverse=True)
                if REPEATS * len(values) <= rows:
                    merged.append((one[0], two[1], codes, len(values)))
                    at += 2
                    continue
            merged.append(one)
            at += 1
        if len(merged) == len(blocks):
            break
        blocks = merged
    out = []
    for first, end, codes, n in blocks:
        at = np.empty(n, dtype=np.int64)  # a row that holds each entry
        at[codes] = np.arange(rows)
        out.append((first, vectors[at, first:end], codes))
    return out


def distances(blocks, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (vectors x centroids), from those of the entries."""
    total = 0
    for first, entries, codes in blocks:
        apart = entries[:, None, :] - centroids[None, :, first : first + entries.shape[1]]
        total = total + (apart * apart).sum(axis=2)[codes]
    return total


def sums(blocks, cluster: np.ndarray, k: int, columns: int) -> np.ndarray:
    """Componentwise sums of each cluster's vectors (k x columns), from counts of codes."""
    out = np.zeros((k, columns), dtype=np.int64)
    for first, entries, codes in blocks:
        n = len(entries)
        counts = np.bincount(cluster * n + codes, minlength=k * n).reshape(k, n)
        out[:, first : first + entries.shape[1]] = counts @ entries
    return out


def _encoder(chunk: int):
    def flush(held):
        table = pa.Table.from_batches(held)
        flat = table.column("vector").combine_chunks()
        vectors = flat.flatten().to_numpy().reshape(len(flat), -1)
        if vectors.size and np.abs(vectors).max() > LARGEST:
            raise ValueError(f"a component beyond {LARGEST}: its squared distances would not fit 64 bits")
        blocks = [
            {"first": f, "width": e.shape[1], "entries": e.astype("<i4").tobytes(), "codes": c.astype("<u2").tobytes()}
            for f, e, c in encode(vectors)
        ]
        ids = table.column("id").combine_chunks()
        ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.record_batch([ids, pa.array([blocks], _BLOCK_ARROW)], names=["ids", "blocks"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, chunk - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == chunk:
                    yield flush(held)
                    held, rows = [], 0
        if rows:
            yield flush(held)

    return run


def _chunks(batches):
    """The ids and blocks of every chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            blocks = []
            for b in batch.column("blocks")[i].as_py():
                entries = np.frombuffer(b["entries"], dtype="<i4").astype(np.int64).reshape(-1, b["width"])
                blocks.append((b["first"], entries, np.frombuffer(b["codes"], dtype="<u2").astype(np.int64)))
            yield batch.column("ids").slice(i, 1).flatten(), blocks


def _nearest(blocks, centroids):
    apart = distances(blocks, centroids)
    cluster = apart.argmin(axis=1)  # the first of equals
    return cluster, apart[np.arange(len(cluster)), cluster]


def _round(centroids: np.ndarray):
    """Per task and cluster: vectors, sum per component, sum of distances."""

    def run(batches):
        k, columns = centroids.shape
        rows, total, apart = np.zeros(k, np.int64), np.zeros((k, columns), np.int64), np.zeros(k, np.int64)
        for _, blocks in _chunks(batches):
            cluster, distance = _nearest(blocks, centroids)
            rows += np.bincount(cluster, minlength=k)
            total += sums(blocks, cluster, k, columns)
            np.add.at(apart, cluster, distance)
        met = np.flatnonzero(rows)
        yield pa.record_batch(
            [pa.array(met), pa.array(rows[met]), pa.array(total[met].tolist(), pa.list_(pa.int64())), pa.array(apart[met])],
            names=["cluster", "n", "total", "apart"],
        )

    return run


def _measure(encoded: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int], int]]:
    """Per cluster with vectors: how many, their sums, their summed distance. k rows come to the driver."""
    told = map_batches(encoded, _round(centroids), T.StructType.fromDDL("cluster long, n long, total array<long>, apart long"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    parts = told.select("cluster", "n", "apart", F.posexplode("total").alias("at", "total"))
    found = parts.groupBy("cluster", "at").agg(exact("n"), exact("total"), exact("apart")).collect()
    out: dict[int, tuple[int, list[int], int]] = {}
    for r in sorted(found, key=lambda r: (r["cluster"], r["at"])):
        out.setdefault(r["cluster"], (int(r["n"]), [], int(r["apart"])))[1].append(int(r["total"]))
    return out


def _assign(centroids: np.ndarray):
    def run(batches):
        for ids, blocks in _chunks(batches):
            cluster, distance = _nearest(blocks, centroids)
            yield pa.record_batch([ids, pa.array(cluster, pa.int32()), pa.array(distance)], names=["id", "cluster", "distance"])

    return run


def whole_vectors(df: DataFrame, doc: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(id, vector) of the rows with exactly ``dims`` finite components, each floor(scale * x)."""
    x = F.col(f"`{vector}`")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    kept = df.filter(F.coalesce((F.size(x) == dims) & finite, F.lit(False)))
    return kept.select(F.col(f"`{doc}`").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("vector"))


def cluster(
    df: DataFrame,
    doc: str = "vec_id",
    vector: str = "embedding",
    dims: int = 64,
    k: int = 8,
    rounds: int = 10,
    scale: int = 1024,
    seed: str = "3",
    chunk: int = CHUNK,
) -> DataFrame:
    """Cluster vectors: doc, cluster, distance, cluster_inertia, inertia, centroid.

    Rows with exactly ``dims`` components, none null, NaN or infinite, are kept;
    each component x becomes floor(scale * x). The first centroids are the k kept
    vectors with the smallest SHA-256 of seed, colon and id (a null id counts as
    empty; equal ids by their vectors). A round gives every vector to the nearest
    centroid, the smaller number of equals, and moves every non-empty one to the
    floor of its vectors' mean; vectors are given out once more at the end. All
    is exact; a component beyond 2^27 raises. Fewer than k vectors give fewer
    centroids; none, or an empty table, no rows. Repeated rows are vectors
    each; other columns are ignored. The encoded vectors stay in a folder of
    their own under ``spark.checkpoint.dir``, as the result is read from them.
    """
    spark = df.sparkSession
    vectors = whole_vectors(df, doc, vector, dims, scale)
    schema = T.StructType([T.StructField("ids", T.ArrayType(vectors.schema["id"].dataType)), T.StructField("blocks", T.ArrayType(_BLOCK))])
    encoded = materialize(map_batches(vectors, _encoder(chunk), schema), "encoded-vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = vectors.orderBy(digest, "vector").limit(k).collect()
    centroids = np.array([r["vector"] for r in start], dtype=np.int64).reshape(len(start), dims)
    for _ in range(rounds if len(start) else 0):
        for c, (n, total, _) in _measure(encoded, centroids).items():
            centroids[c] = [t // n for t in total]
    found = _measure(encoded, centroids) if len(start) else {}
    inertia = sum(apart for _, _, apart in found.values())
    rows = [(c, found[c][2], inertia, centroids[c].tolist()) for c in found]
    # one row per centroid
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    given = T.StructType([T.StructField("id", vectors.schema["id"].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    out = map_batches(encoded, _assign(centroids), given) if rows else spark.createDataFrame([], given)
    return out.join(F.broadcast(named), "cluster").select(
        F.col("id").alias(doc), "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )
