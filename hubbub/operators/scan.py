"""Prefix scans over a whole channel that no single task has to read.

A running number, a running sum, the row before, the last known value: each needs all rows of a
channel in order. Instead of one window over the channel, rows are dealt by Spark's range
partitioning over (channel, order) and written; each range of a channel is scanned for itself;
one small row for each channel and range carries its count, sum or last value over the borders;
the carry is joined back. A channel with most of all rows is so spread over as many ranges as
its size asks for (spark.sql.shuffle.partitions).

Rows: a null channel is a channel; equal orders are neighbours, in no stated order; an empty
table gives no rows; columns named _range and _index are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import stored

RANGE, INDEX = "_range", "_index"
_BITS = 33


def ranged(rows: DataFrame, by: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """rows with `_range`, the number of its range, and `_index`, its place there; written, so that every reader sees the same ranges."""
    keys = [*by, *order]
    dealt = rows.repartitionByRange(ranges, *keys) if ranges else rows.repartitionByRange(*keys)
    at = F.monotonically_increasing_id()
    dealt = dealt.sortWithinPartitions(*keys).withColumn(INDEX, at)
    return stored(dealt.withColumns({RANGE: F.shiftright(INDEX, _BITS), INDEX: F.col(INDEX).bitwiseAND(F.lit((1 << _BITS) - 1))}), "ranges")


def _carried(rows: DataFrame, borders: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of borders (one row for each channel and range)."""
    names = {c: f"_carry_{c}" for c in [*by, RANGE]}
    renamed = borders.withColumnsRenamed(names)
    on = F.col(RANGE) == F.col(names[RANGE])
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(names[c]))
    return rows.join(renamed, on).drop(*names.values())


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "place", ranges: int | None = None) -> DataFrame:
    """rows with their number (from 1) within `by` in order; no window over rows at all."""
    own = ranged(rows, by, order, ranges)
    counts = own.groupBy(*by, RANGE).agg(F.min(INDEX).alias("_first"), F.count("*").alias("_n"))
    past = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    start = counts.withColumn("_before", F.coalesce(F.sum("_n").over(past), F.lit(0)) - F.col("_first")).drop("_first", "_n")
    return _carried(own, start, by).withColumn(name, F.col("_before") + F.col(INDEX) + 1).drop("_before", RANGE, INDEX)


def scanned(
    rows: DataFrame, by: list[str], sums: dict[str, Column] | None = None, befores: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None
) -> DataFrame:
    """Rows of ranged() with running sums (the row itself included), values of the row before, and last values that are not null (the row's own included)."""
    sums, befores, lasts = sums or {}, befores or {}, lasts or {}
    inside = Window.partitionBy(*by, RANGE).orderBy(INDEX)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy(*by).orderBy(RANGE)
    past = over.rowsBetween(Window.unboundedPreceding, -1)
    held = {n: F.struct(c.alias("v")) for n, c in befores.items()}
    known = {n: F.when(c.isNotNull(), F.struct(c.alias("v"))) for n, c in lasts.items()}
    borders = rows.groupBy(*by, RANGE).agg(
        *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()],
        *[F.max_by(c, INDEX).alias(f"_b_{n}") for n, c in held.items()],
        *[F.max_by(c, F.when(c.isNotNull(), F.col(INDEX))).alias(f"_l_{n}") for n, c in known.items()],
    )
    borders = borders.select(
        *by, RANGE,
        *[F.coalesce(F.sum(f"_s_{n}").over(past), F.lit(0)).alias(f"_s_{n}") for n in sums],
        *[F.lag(f"_b_{n}").over(over).alias(f"_b_{n}") for n in befores],
        *[F.last(f"_l_{n}", True).over(past).alias(f"_l_{n}") for n in lasts],
    )
    found = _carried(rows, borders, by)
    found = found.select(
        *rows.columns,
        *[(F.col(f"_s_{n}") + F.sum(c).over(upto)).alias(n) for n, c in sums.items()],
        *[F.coalesce(F.lag(c).over(inside), F.col(f"_b_{n}"))["v"].alias(n) for n, c in held.items()],
        *[F.coalesce(F.last(c, True).over(upto), F.col(f"_l_{n}"))["v"].alias(n) for n, c in known.items()],
    )
    return found
