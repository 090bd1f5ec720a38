"""Pairs of texts whose word n-grams overlap: candidates by MinHash, pruned by their posterior, verified exactly.

Equal texts are one text here; a link joins two different texts. Candidates
share a band of MinHash values. Their values are compared a few at a time: with
a uniform prior on the similarity, a pair is dropped as soon as the probability
that it reaches the threshold falls below a tolerance (BayesLSH, Satuluri and
Parthasarathy 2012). What remains is verified on the n-grams themselves.

Texts are first gathered into clusters that the pruned candidates connect, then
each cluster's pairs are verified in one place, so a text's n-grams travel once
and not once per shared band. Buckets and clusters larger than a block are dealt
out as pairs of blocks, so no task holds more than two blocks of a group. Links
are counted where they are found; only counts and spanning edges leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .graph import components
from .shared import map_batches, materialize

WORDS = 5
THRESHOLD = 0.8
#: MinHash values of a text
HASHES = 125
#: a pair at the threshold shares no band with at most this probability
MISS = 1e-4
#: MinHash values compared at a time
STEP = 25
#: a pair is dropped when it reaches the threshold with less than this probability
TOLERANCE = 1e-5
#: texts of one group that a task holds, twice
BLOCK = 1024
BLOCK_BYTES = 24 << 20
_PAIRS = 1 << 17
_ENUMERATED = 64


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After each step, the fewest equal values with P(similarity >= threshold) >= tolerance.

    With a uniform prior the posterior after m of n equal values is
    Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail = lambda m: sum(comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))
        # a threshold of 1 leaves no probability above it: all values must be equal
        out.append(next((m for m in range(n + 1) if tail(m) >= tolerance), n))
    return out


def band_rows(threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """The most MinHash values a band may have for a pair at the threshold to share one, but for ``miss``.

    At 0.8 these are 5, in 25 bands: (1 - 0.8 ** 5) ** 25 = 5e-5. Raises if
    bands of one value are not enough, below a threshold of about 0.07.
    """
    enough = [r for r in range(1, HASHES + 1) if (1 - threshold**r) ** (HASHES // r) <= miss]
    if not enough:
        raise ValueError(f"{HASHES} MinHash values cannot find pairs at a threshold of {threshold}")
    return max(enough)


def _multipliers() -> np.ndarray:
    return np.random.default_rng(29).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values (rows, HASHES) of texts that have at least one n-gram each."""
    out = np.empty((len(starts) - 1, HASHES), dtype=np.uint32)
    for k, a in enumerate(_multipliers()):
        out[:, k] = np.minimum.reduceat((grams * a) >> np.uint64(32), starts[:-1])
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a 2-d array."""
    n, width = len(rows), rows.shape[1] * rows.itemsize
    ends = pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _sign(words: int):
    def run(batches):
        for batch in batches:
            for piece in tokens.slices(batch, "text"):
                flat, starts = tokens.words(piece.column("text"))
                grams, at = tokens.grams(flat, starts, words)
                some = np.flatnonzero(np.diff(at))
                values = np.zeros((len(piece), HASHES), dtype=np.uint32)
                if len(some):
                    values[some] = signatures(grams, np.append(at[:-1][some], at[-1]))
                counts = np.diff(at)
                sig = pc.if_else(pa.array(counts > 0), _binary(values), pa.scalar(None, pa.binary()))
                yield pa.record_batch(
                    [piece.column("doc_id"), piece.column("fp"), sig, pa.array(counts, pa.int64())],
                    names=["doc_id", "fp", "sig", "grams"],
                )

    return run


def _shingle(words: int):
    def run(batches):
        for batch in batches:
            for piece in tokens.slices(batch, "text"):
                flat, starts = tokens.words(piece.column("text"))
                grams, at = tokens.grams(flat, starts, words)
                sets = [np.unique(grams[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
                keep = [c for c in piece.schema.names if c != "text"]
                yield pa.record_batch([*[piece.column(c) for c in keep], pa.array(sets, pa.binary())], names=[*keep, "set"])

    return run


# --- inside a task: groups of rows, sorted by group ---


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """A binary column of equal lengths as rows of numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype=dtype).reshape(len(column), width)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups with the first row of each group (and one more)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cut = np.flatnonzero(_changes(pa.Table.from_batches([batch]), keys))
        new_here = len(cut) > 0 or (held and _differ(held[-1], batch, keys))
        if not new_here:
            held.append(batch)
            continue
        last = int(cut[-1]) + 1 if len(cut) else 0
        done = [*held, batch.slice(0, last)] if last else held
        yield _with_starts(pa.Table.from_batches(done), keys)
        held = [batch.slice(last)]
    if held:
        yield _with_starts(pa.Table.from_batches(held), keys)


def _differ(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> bool:
    return any(a.column(k)[a.num_rows - 1].as_py() != b.column(k)[0].as_py() for k in keys)


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """For each row but the last whether the next belongs to another group."""
    out = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
    for k in keys:
        column = table.column(k).combine_chunks()
        if table.num_rows > 1:
            out |= pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy(zero_copy_only=False)
    return out


def _with_starts(table: pa.Table, keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    cuts = np.flatnonzero(_changes(table, keys)) + 1
    return table.combine_chunks(), np.concatenate([[0], cuts, [table.num_rows]]).astype(np.int64)


def _alike(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs (i, j) outlive the incremental comparison."""
    alive = np.arange(len(i))
    equal = np.zeros(len(i), dtype=np.int32)
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        equal = equal + (sig[i[alive], part] == sig[j[alive], part]).sum(axis=1)
        keep = equal >= need
        alive, equal = alive[keep], equal[keep]
        if not len(alive):
            break
    return alive


def _pairs(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (i, j) with first[i] <= j < last[i], a bounded number at a time."""
    counts = np.maximum(last - first, 0)
    sums = np.concatenate([[0], np.cumsum(counts)])
    at = 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(sums, sums[at] + _PAIRS, "right")) - 1)
        n = counts[at:end]
        if n.sum():
            i = np.repeat(np.arange(at, end), n)
            j = np.arange(len(i)) - np.repeat(sums[at:end] - sums[at], n) + np.repeat(first[at:end], n)
            yield i, j
        at = end


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give the rows that the pairs connect one label, the least row."""
    while len(i):
        low = np.minimum(label[i], label[j])
        high = np.maximum(label[i], label[j])
        differ = low < high
        i, j, low, high = i[differ], j[differ], low[differ], high[differ]
        if not len(i):
            return
        np.minimum.at(label, high, low)
        # follow labels to their roots
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label[:] = further


def _connect(least: list[int]):
    """Spanning edges between the texts of each bucket that outlive the comparison."""

    def search(sig: np.ndarray, label: np.ndarray, a: int, b: int) -> None:
        # breadth first: what has joined is compared only with what has not
        rest = np.arange(a, b)
        while len(rest) > 1:
            root, rest = rest[0], rest[1:]
            queue = [root]
            while queue and len(rest):
                x = queue.pop()
                met = _alike(sig, np.full(len(rest), x), rest, least)
                queue.extend(rest[met].tolist())
                label[rest[met]] = root
                rest = np.delete(rest, met)

    def run(batches):
        for table, starts in _whole_groups(batches, ["key", "lo", "hi"]):
            sig = _matrix(table.column("sig"), np.uint32, HASHES)
            label = np.arange(len(sig))
            sizes = np.diff(starts)
            last = np.repeat(np.where(sizes <= _ENUMERATED, starts[1:], 0), sizes)
            for i, j in _pairs(np.arange(len(sig)) + 1, last):
                met = _alike(sig, i, j, least)
                _merge(label, i[met], j[met])
            for g in np.flatnonzero(sizes > _ENUMERATED):
                search(sig, label, int(starts[g]), int(starts[g + 1]))
            moved = np.flatnonzero(label != np.arange(len(label)))
            if len(moved):
                fp = table.column("fp").combine_chunks()
                yield pa.record_batch([fp.take(pa.array(moved)), fp.take(pa.array(label[moved]))], names=["a", "b"])

    return run


def _verify(least: list[int], threshold: float):
    """Per text of a cluster's pair of blocks: its links there, and a text it is connected with."""

    def run(batches):
        for table, _ in _whole_groups(batches, ["root", "lo", "hi"]):
            # a row repeated in the input is one text
            same = np.concatenate([[False], ~_changes(table, ["root", "lo", "hi", "fp"])])
            table, starts = _with_starts(table.filter(pa.array(~same)), ["root", "lo", "hi"])
            sig = _matrix(table.column("sig"), np.uint32, HASHES)
            sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("set").to_pylist()]
            lo, hi, side = (table.column(c).to_numpy() for c in ("lo", "hi", "side"))
            rows = np.arange(len(sig))
            end = np.repeat(starts[1:], np.diff(starts))
            # rows of a group are sorted by side: the other side begins after the last row of lo
            on_lo = np.add.reduceat(side == lo, starts[:-1], dtype=np.int64)
            across = np.repeat(starts[:-1] + on_lo, np.diff(starts))
            first = np.where(lo == hi, rows + 1, np.where(side == lo, across, end))
            links = np.zeros(len(sig), dtype=np.int64)
            label = rows.copy()
            book = _Sets(sets)
            for i, j in _pairs(first, end):
                met = _alike(sig, i, j, least)
                i, j = i[met], j[met]
                both = book.common(i, j)
                sizes = book.sizes
                # both / union >= threshold, in whole numbers where the threshold allows it
                linked = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
                i, j = i[linked], j[linked]
                links += np.bincount(i, minlength=len(links)) + np.bincount(j, minlength=len(links))
                _merge(label, i, j)
            fp = table.column("fp").combine_chunks()
            some = np.flatnonzero(links)
            if len(some):
                take = pa.array(some)
                yield pa.record_batch(
                    [fp.take(take), pa.array(links[some]), fp.take(pa.array(label[some]))], names=["fp", "links", "root"]
                )

    return run


class _Sets:
    """Sizes of intersections for many pairs of sorted sets."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        distinct, self.number = np.unique(values, return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.marks = np.zeros(len(distinct), dtype=bool)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=np.int64)
        for a, b in _runs(i):
            own = self.number[self.starts[i[a]] : self.starts[i[a] + 1]]
            self.marks[own] = True
            sizes = self.sizes[j[a:b]]
            ends = np.cumsum(sizes)
            places = np.arange(ends[-1]) + np.repeat(self.starts[j[a:b]] - (ends - sizes), sizes)
            out[a:b] = np.add.reduceat(self.marks[self.number[places]], ends - sizes, dtype=np.int64)
            self.marks[own] = False
        return out


def _runs(i: np.ndarray, most: int = 2048) -> Iterator[tuple[int, int]]:
    """Runs of equal values of ``i``, in pieces of at most ``most``."""
    cuts = np.flatnonzero(np.diff(i)) + 1
    for a, b in zip(np.append(0, cuts)[: len(i)], np.append(cuts, len(i))):
        for x in range(int(a), int(b), most):
            yield x, min(int(b), x + most)


# --- the plan ---


def _fields(df: DataFrame, *names: str) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def _dealt(df: DataFrame, blocks: str) -> DataFrame:
    """Each row once per pair of blocks its own takes part in: lo <= hi, side its own block."""
    own = F.pmod(F.xxhash64("fp"), F.col(blocks)).cast("int")
    df = df.withColumn("side", own)
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
    return df.withColumns({"lo": F.least("side", "_other"), "hi": F.greatest("side", "_other")}).drop("_other", blocks)


def jaccard_links(
    df: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """One row per row of ``df``: doc_id, text_md5, class_id, class_md5, links.

    ``links`` counts the different texts whose sets of ``words``-word n-grams
    have a Jaccard similarity of ``threshold`` or more with this one. Texts
    connected by links, and equal texts, form a class, named after the row with
    the least doc_id (then the least text_md5) in it: class_id and class_md5.

    Words are runs of letters and digits, in lower case; a text of fewer words
    than an n-gram has one n-gram, all its words. A text without words has
    links to nothing; equal ones are a class. A null text belongs to no class:
    text_md5, class_id and class_md5 are null and links is 0. A null doc_id
    counts as larger than any other. Repeated rows are equal texts. An empty
    table gives an empty one. Other columns are ignored. Bands follow from the
    threshold (``band_rows``); one below about 0.07 raises.
    """
    least, width = least_matches(threshold, tolerance), band_rows(threshold)
    narrow = df.select(F.col(f"`{doc}`").alias("doc_id"), F.unhex(F.md5(F.col(f"`{text}`"))).alias("fp"), F.col(f"`{text}`").alias("text"))
    fields = _fields(narrow, "doc_id", "fp")
    signed_schema = T.StructType([*fields, T.StructField("sig", T.BinaryType()), T.StructField("grams", T.LongType())])
    signed = materialize(map_batches(narrow, _sign(words), signed_schema), "signed")

    texts = signed.filter(F.col("fp").isNotNull()).groupBy("fp").agg(
        F.min("doc_id").alias("doc_id"), F.max("sig").alias("sig"), F.max("grams").alias("grams")
    )
    texts = materialize(texts, "texts")

    # buckets: texts that agree in a band; one of each set of equal buckets
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(HASHES // width - 1)),
        lambda b: F.xxhash64(b, F.substring("sig", b * (width * 4) + 1, F.lit(width * 4))),
    )
    banded = texts.filter(F.col("sig").isNotNull()).select("fp", F.posexplode(bands).alias("band", "key"))
    buckets = banded.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("band").alias("band"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.min("fp").alias("first")
    )
    buckets = buckets.filter("n > 1").groupBy("n", "x", "first").agg(F.min(F.struct("band", "key")).alias("b"))
    buckets = buckets.select(F.col("b.key").alias("key"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = banded.select("key", "fp").join(buckets, "key").join(texts.select("fp", "sig"), "fp")
    members = _dealt(members, "blocks").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    pair_schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    near = map_batches(members.select("key", "lo", "hi", "fp", "sig"), _connect(least), pair_schema)
    clusters = materialize(components(near), "clusters")

    # exact verification, cluster by cluster
    inside = clusters.select(F.col("node").alias("fp"), "root").join(texts, "fp")
    sizes = inside.groupBy("root").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("grams") * 8 / BLOCK_BYTES)).cast("int").alias("blocks")
    )
    inside = inside.join(sizes, "root")
    chosen = narrow.alias("n").join(
        inside.alias("i"), (F.col("n.fp") == F.col("i.fp")) & F.col("n.doc_id").eqNullSafe(F.col("i.doc_id"))
    )
    chosen = chosen.select("i.root", "i.blocks", "i.fp", "i.sig", "n.text")
    set_schema = T.StructType(
        [T.StructField("root", T.BinaryType()), T.StructField("blocks", T.IntegerType()), T.StructField("fp", T.BinaryType()),
         T.StructField("sig", T.BinaryType()), T.StructField("set", T.BinaryType())]
    )
    chosen = _dealt(map_batches(chosen, _shingle(words), set_schema), "blocks")
    chosen = chosen.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "side", "fp")
    link_schema = T.StructType(
        [T.StructField("fp", T.BinaryType()), T.StructField("links", T.LongType()), T.StructField("root", T.BinaryType())]
    )
    verified = materialize(
        map_batches(chosen.select("root", "lo", "hi", "side", "fp", "sig", "set"), _verify(least, threshold), link_schema), "verified"
    )
    links = verified.groupBy("fp").agg(F.sum("links").alias("links"))
    classes = components(verified.select(F.col("fp").alias("a"), F.col("root").alias("b")))
    linked = links.join(classes.select(F.col("node").alias("fp"), "root"), "fp")

    # back to the rows
    every = texts.select("fp", "doc_id").join(linked, "fp", "left")
    every = materialize(every.select("fp", "doc_id", F.coalesce("root", "fp").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "every")
    names = every.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("name"))
    every = every.join(names, "root").select(
        "fp", F.col("name.doc_id").alias("class_id"), F.col("name.fp").alias("class_fp"), "links"
    )
    out = signed.select("doc_id", "fp").join(every, "fp", "left")
    hexed = lambda c: F.lower(F.hex(c))
    return out.select(
        "doc_id",
        hexed("fp").alias("text_md5"),
        "class_id",
        hexed("class_fp").alias("class_md5"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
    )
