"""Ranks, differences and last rows inside ordered groups.

A Spark window brings every row of a partition key to one task. That is the
plain plan, right where groups are small by nature, as games are. Where one key
may hold a large share of all rows, give ``rows``, what one task may hold of a
group: groups beyond it are cut along their order. The cuts are values of the
order, found once from a bounded sample (``find_cuts``) and part of the plan from
then on; a row's slice follows from the row alone, whatever is cached, lost or
computed again. Each (group, slice) is a window of its own, rows are shuffled
once, and a table of one row per slice carries counts, sums, last values and
maxima across the cuts. A table without such a group gets the plain plan.
The results are equal; the tests compare both with brute force.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cycle_position, remap

#: rows of one group that a task may hold
ROWS = 4_000_000
#: a group is cut into so many slices at most; beyond that they grow
MOST_SLICES = 2048
#: rows drawn to find large groups and their cuts, held by the driver
SAMPLE = 100_000


def _null_safe(a: str, b: str, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in keys])


def _ascending(values: Sequence) -> tuple:
    """A sort key that orders values as Spark does: missing first, NaN last."""
    return tuple((0, 0) if v is None else (2, 0) if v != v else (1, v) for v in values)


@dataclass(frozen=True)
class Cuts:
    """Large groups and where they are cut: per group an ascending list of (order values, after).

    A slice begins at the values of its cut, or just after them. A value that
    would fill several slices has one to itself; ``spread`` says over how many
    tasks its rows are dealt where their own order does not matter.
    """

    part: tuple[str, ...]
    order: tuple[str, ...]
    groups: tuple[tuple[tuple, tuple[tuple[tuple, int], ...], tuple[tuple[int, int], ...]], ...]

    def slice(self, df: DataFrame) -> DataFrame:
        """Add ``_slice`` and ``_spread``: NULL for rows of groups that are not cut."""
        place = [T.StructField(f"_{i}", df.schema[c].dataType) for i, c in enumerate(self.order)]
        bound = T.StructType([*place, T.StructField("_after", T.IntegerType())])
        schema = T.StructType(
            [T.StructField(f"_g{i}", df.schema[c].dataType) for i, c in enumerate(self.part)]
            + [
                T.StructField("_bounds", T.ArrayType(T.ArrayType(bound))),
                T.StructField("_dealt", T.MapType(T.IntegerType(), T.IntegerType())),
            ]
        )
        rows = []
        for values, bounds, spread in self.groups:
            flat = [(*b, after) for b, after in bounds]
            width = max(1, math.isqrt(len(flat)))
            rows.append((*values, [flat[i : i + width] for i in range(0, len(flat), width)], dict(spread)))
        # one row per large group, one entry per slice
        table = F.broadcast(df.sparkSession.createDataFrame(rows, schema)).alias("_c")
        same = [F.col(f"_r.`{c}`").eqNullSafe(F.col(f"_c._g{i}")) for i, c in enumerate(self.part)]
        here = F.struct(*[F.col(f"_r.`{c}`").alias(f"_{i}") for i, c in enumerate(self.order)], F.lit(0).alias("_after"))
        # the last run of cuts that begins here or before, then the place in that run
        runs = F.size(F.filter(F.col("_c._bounds"), lambda run: run[0] <= here))
        width = F.size(F.col("_c._bounds")[0])
        inside = F.size(F.filter(F.col("_c._bounds")[runs - 1], lambda b: b <= here))
        number = F.when(F.col("_c._bounds").isNull(), None).when(runs == 0, 0).otherwise((runs - 1) * width + inside)
        joined = df.alias("_r").join(table, reduce(lambda x, y: x & y, same), "left")
        kept = [F.col(f"_r.`{c}`") for c in df.columns]
        cut = joined.select(*kept, number.alias("_slice"), F.col("_c._dealt").alias("_dealt"))
        tasks = F.element_at("_dealt", F.col("_slice"))
        spread = F.when(tasks.isNotNull(), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), tasks))
        return cut.withColumn("_spread", spread).drop("_dealt")


def find_cuts(
    df: DataFrame, part: Sequence[str], order: Sequence[str], rows: int = ROWS, most: int = MOST_SLICES, sample: int = SAMPLE
) -> Cuts | None:
    """Where groups of more than ``rows`` rows are cut; None if there are none.

    Counts the rows, and where they exceed ``rows`` draws a sample of about
    ``sample`` of them. Any cuts give the right result; the sample decides only
    how even the slices are.
    """
    keys = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*part, *order])])
    total = keys.count()
    if total <= rows:
        return None
    drawn = keys.sample(min(1.0, sample / total), seed=17).collect()
    groups = defaultdict(list)
    for r in drawn:
        groups[tuple(r[c] for c in part)].append(tuple(r[c] for c in order))
    large = []
    for values, places in groups.items():
        n = min(most, math.ceil(len(places) * total / (len(drawn) * rows)))
        if n < 2 or len(places) < n:
            continue
        places.sort(key=_ascending)
        chosen = [places[len(places) * i // n] for i in range(1, n)]
        bounds, spread = [], []
        for i, b in enumerate(chosen):
            if i and _ascending(b) == _ascending(chosen[i - 1]):
                continue
            repeats = sum(_ascending(c) == _ascending(b) for c in chosen[i:])
            bounds.append((b, 0))
            if repeats > 1:
                spread.append((len(bounds), repeats + 1))
                bounds.append((b, 1))
        large.append((values, tuple(bounds), tuple(spread)))
    return Cuts(tuple(part), tuple(order), tuple(large)) if large else None


def ordered_scan(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[str],
    *,
    row_number: str | None = None,
    previous: Mapping[str, str] | None = None,
    sum_before: Mapping[str, str] | None = None,
    group_max: Mapping[str, str] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add columns that depend on a row's place in its ordered group.

    ``row_number``: name of the 1-based place. ``previous``: new name -> column
    of the preceding row (NULL on the first). ``sum_before``: new name ->
    column summed over all preceding rows (0 on the first). ``group_max``: new
    name -> column, its maximum over the whole group. ``order`` (ascending)
    must be unique inside a group for everything but ``group_max``.
    An empty ``part`` makes the whole table one group. ``rows``: cut larger
    groups, see above; None is the plain plan.
    """
    previous, sum_before, group_max = dict(previous or {}), dict(sum_before or {}), dict(group_max or {})
    if not part:
        whole = df.withColumn("_all", F.lit(0))
        return ordered_scan(
            whole, ["_all"], order, row_number=row_number, previous=previous,
            sum_before=sum_before, group_max=group_max, rows=rows,
        ).drop("_all")
    cuts = find_cuts(df, part, order, rows) if rows else None
    keys = [*part, "_slice"] if cuts else list(part)
    sliced = cuts.slice(df).drop("_spread") if cuts else df

    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*keys)
    new = {}
    if row_number or cuts:
        new[row_number or "_place"] = F.row_number().over(w).cast("long")
    new |= {name: F.lag(c).over(w) for name, c in previous.items()}
    new |= {name: F.coalesce(F.sum(c).over(before), F.lit(0)) for name, c in sum_before.items()}
    new |= {name: F.max(c).over(group) for name, c in group_max.items()}
    local = sliced.withColumns(new)
    if not cuts:
        return local
    return _carry(sliced, local, part, order, row_number, previous, sum_before, group_max)


def _carry(sliced, local, part, order, row_number, previous, sum_before, group_max) -> DataFrame:
    """Add what the other slices of a cut group contribute."""
    place = row_number or "_place"
    at = F.struct(*[F.col(c) for c in order])  # never missing itself
    edges = sliced.filter(F.col("_slice").isNotNull()).groupBy(*part, "_slice").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.max_by(F.struct(F.lit(0).alias("_x"), *[F.col(c).alias(f"_last_{n}") for n, c in previous.items()]), at).alias("_last"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_sum_{n}") for n, c in sum_before.items()],
        *[F.max(c).alias(f"_max_{n}") for n, c in group_max.items()],
    )
    w = Window.partitionBy(*part).orderBy("_slice")
    before, group = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*part)
    carry = edges.select(
        *part,
        "_slice",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_c_rows"),
        F.lag("_last").over(w).alias("_c_last"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_c_sum_{n}") for n in sum_before],
        *[F.max(f"_max_{n}").over(group).alias(f"_c_max_{n}") for n in group_max],
    )
    # one row per slice of a cut group, whatever the data
    out = local.alias("a").join(F.broadcast(carry).alias("b"), _null_safe("a", "b", [*part, "_slice"]), "left")
    cut = F.col("b._slice").isNotNull()
    fresh = {place, *previous, *sum_before, *group_max}
    cols = [F.col(f"a.{c}") for c in local.columns if c not in fresh and c != "_slice"]
    started = F.col(f"a.{place}") == 1
    if row_number:
        cols.append((F.col(f"a.{place}") + F.coalesce(F.col("_c_rows"), F.lit(0))).alias(place))
    for n in previous:
        carried = F.when(started & F.col("_c_last").isNotNull(), F.col(f"_c_last._last_{n}"))
        cols.append(carried.otherwise(F.col(f"a.{n}")).alias(n))
    for n in sum_before:
        cols.append((F.col(f"a.{n}") + F.coalesce(F.col(f"_c_sum_{n}"), F.lit(0))).alias(n))
    for n in group_max:
        cols.append(F.when(cut, F.col(f"_c_max_{n}")).otherwise(F.col(f"a.{n}")).alias(n))
    return out.select(*cols)


def competition_rank(
    df: DataFrame, part: Sequence[str], order: Sequence[str], name: str = "rank", rows: int | None = None
) -> DataFrame:
    """1 + the number of rows ordered before this one; ties share a rank.

    Cuts are values of the order, so ties stay in one slice and rows keep the
    rank they get there, plus the rows of earlier slices. A value with too many
    ties has a slice to itself, where every row has the same rank, so its rows
    are dealt over several tasks.
    """
    cuts = find_cuts(df, part, order, rows) if rows else None
    if not cuts:
        return df.withColumn(name, F.rank().over(Window.partitionBy(*part).orderBy(*order)).cast("long"))
    sliced = cuts.slice(df)
    local = sliced.withColumn(name, F.rank().over(Window.partitionBy(*part, "_slice", "_spread").orderBy(*order)).cast("long"))
    counts = sliced.filter(F.col("_slice").isNotNull()).groupBy(*part, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*part).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select(*part, "_slice", F.sum("_rows").over(earlier).alias("_before"))
    out = local.alias("a").join(F.broadcast(carry).alias("b"), _null_safe("a", "b", [*part, "_slice"]), "left")
    return out.select(
        *[F.col(f"a.`{c}`") for c in df.columns if c != name],
        (F.col(f"a.{name}") + F.coalesce(F.col("b._before"), F.lit(0))).alias(name),
    )


def cyclic_rank(
    df: DataFrame, part: Sequence[str], order: Sequence[str], n: int, name: str, rows: int | None = None
) -> DataFrame:
    """Place 1..n of each row when the ranks of a group go round a cycle of ``n``."""
    ranked = competition_rank(df, part, order, "_rank", rows)
    return ranked.withColumn(name, cycle_position("_rank", n)).drop("_rank")


def state_change(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[str],
    state: str,
    name: str = "change",
    wrap: Mapping[int, int] | None = None,
    first: int = 0,
    last_by: str | None = None,
    on_last: Column | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Difference of ``state`` to the preceding row of the group.

    The first row gets ``first``; a missing state in mid-series gives a missing
    change. ``wrap`` replaces differences that mean a wrap-around. On the rows
    with the group's largest ``last_by``, ``on_last`` (which may use the column
    ``name``) decides instead.
    """
    scanned = ordered_scan(
        df,
        part,
        order,
        row_number="_nth",
        previous={"_before": state},
        group_max={"_final": last_by} if last_by else None,
        rows=rows,
    )
    change = F.when(F.col("_nth") == 1, F.lit(first)).otherwise(F.col(state) - F.col("_before"))
    out = scanned.withColumn(name, change)
    if wrap:
        out = out.withColumn(name, remap(name, wrap))
    if last_by:
        is_last = F.coalesce(F.col(last_by) == F.col("_final"), F.lit(False))
        out = out.withColumn(name, F.when(is_last, on_last).otherwise(F.col(name)))
    return out.drop("_nth", "_before", "_final")


def surrogate_key(df: DataFrame, key: Sequence[str], prefix: str, name: str, rows: int | None = ROWS) -> DataFrame:
    """``prefix_1``, ``prefix_2``, ... in the order of a unique key.

    The whole table is one ordered group; beyond ``rows`` rows it is numbered
    slice by slice; None numbers it in one task, for small tables.
    """
    numbered = ordered_scan(df, [], key, row_number="_number", rows=rows)
    return numbered.withColumn(name, F.concat_ws("_", F.lit(prefix), F.col("_number"))).drop("_number")
