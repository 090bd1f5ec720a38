"""Shards whose source mixture is the corpus's: proportional stratified interleaving. Native columns only.

Rows are shuffled inside their source by a seeded hash and ranked; row r of n
stands at (2 r - 1) / 2n of the whole, whatever its source, and the order of
these fractions is cut into runs of equal length. Both orders are taken in
buckets that are even by construction (a hash; a fraction), so no source,
however large, and no whole table is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, materialize

#: rows that one sorted bucket holds on average
BUCKET_ROWS = 8192


def _seeded(seed: int, keys: Sequence[str]) -> Column:
    parts = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("null")) for k in keys]
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 16)


def _places(df: DataFrame, part: Sequence[str], bucket: str, order: Sequence[Column], name: str, of: str) -> DataFrame:
    """Add ``name``, a row's 0-based place in its part, and ``of``, the rows of the part.

    ``bucket`` must ascend with ``order``; each is sorted on its own, and a small
    table says where it starts.
    """
    rows, start, *own = fresh(df, "rows", "start", "bucket_of", *[f"part{i}" for i in range(len(part))])
    counts = df.groupBy(*part, bucket).agg(F.count(F.lit(1)).alias(rows))
    w = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
    before = w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(p).alias(o) for p, o in zip((bucket, *part), own, strict=True)],
        F.coalesce(F.sum(rows).over(before), F.lit(0)).alias(start),
        F.sum(rows).over(w).alias(of),
    )
    inside = Window.partitionBy(*part, bucket).orderBy(*order)
    local = df.withColumn(name, F.row_number().over(inside) - 1)
    on = F.col(bucket) == F.col(own[0])
    for p, o in zip(part, own[1:], strict=True):
        on = on & F.col(p).eqNullSafe(F.col(o))
    return local.join(starts, on).withColumn(name, F.col(name) + F.col(start)).drop(start, *own)


def interleave(
    df: DataFrame,
    shards: int,
    source: str = "source",
    keys: Sequence[str] = ("doc_id",),
    ties: Sequence[str] = (),
    seed: int = 0,
) -> DataFrame:
    """Add ``shard`` (0 .. shards - 1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes differ by one row at most, and so does, up to rounding at the
    cuts, the number of rows of each source. The shuffle hashes ``seed`` and
    ``keys``; rows that agree in these are ordered by ``keys``, then ``ties``;
    rows that agree in all of them are interchangeable.

    A null source is a source of its own; null keys hash like the word null.
    Fewer rows than shards leave shards empty. An empty table gives an empty
    one. Other columns pass through; a column called shard or slot is replaced.
    """
    df = df.drop("shard", "slot")
    total = df.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    s, h, b, r, n, f, g, all_rows = fresh(df, "source_key", "hash", "bucket", "rank", "ranks", "fraction", "place", "places")
    df = df.withColumns({s: F.col(f"`{source}`"), h: _seeded(seed, keys)})
    high = F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
    df = df.withColumn(b, F.shiftright(high * buckets, 32))
    order = [F.col(h), *[F.col(f"`{c}`").asc_nulls_first() for c in (*keys, *ties)]]
    # read twice below, by the counts and by the ranks; so is what follows
    ranked = _places(materialize(df, "shuffled"), [s], b, order, r, n)
    odd = 2 * F.col(r) + 1
    ranked = ranked.withColumns({f: odd / (2 * F.col(n)), b: F.expr(f"(2 * `{r}` + 1) * {buckets}L div (2 * `{n}`)")})
    ranked = materialize(ranked.drop(h, r, n), "ranked")
    placed = _places(ranked, [], b, [F.col(f), F.col(s).asc_nulls_first()], g, all_rows)
    shard = F.expr(f"`{g}` * {shards}L div {max(total, 1)}L")
    placed = placed.withColumn("shard", shard.cast("int"))
    # first place of a shard: ceil(shard * total / shards)
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("slot", F.col(g) - first).drop(s, b, f, g, all_rows)
