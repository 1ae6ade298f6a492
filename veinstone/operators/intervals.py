"""Joins on overlapping ranges within a key, by bins: an equi-join with a few rows per range, never all pairs of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _level(low: str, high: str) -> Column:
    """The power of 8 whose bins are as wide as the range or wider, so that it touches two at most; bins of 64 are the least."""
    length = F.col(high).cast("long") - F.col(low).cast("long") + 1
    return F.greatest(F.lit(2), F.ceil(F.log2(length.cast("double")) / 3)).cast("int")


def overlap_join(left: DataFrame, right: DataFrame, key: str, left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """Rows of left and right with the same key whose closed ranges share a point; columns of right other than key must not clash.

    A range is listed in the bins, two at most, that it touches at its own level and at each wider level that occurs;
    a pair meets at the wider of its two levels, in the first bin that both touch, so it comes once and a range of any
    length costs a few rows. Nulls in a key or bound match nothing; a range whose end lies before its start has no points.
    """
    sides = [
        df.filter(F.col(low) <= F.col(high)).withColumn(f"__level{i}", _level(low, high)) for i, (df, (low, high)) in enumerate(((left, left_range), (right, right_range)))
    ]
    levels = sorted({r.v for i, side in enumerate(sides) for r in side.select(F.col(f"__level{i}").alias("v")).distinct().collect()})  # at most 22
    if not levels:
        levels = [2]
    listed = []
    for i, (side, (low, high)) in enumerate(zip(sides, (left_range, right_range))):
        own = F.col(f"__level{i}")
        placed = side.withColumn("__at", F.explode(F.array_compact(F.array(*[F.when(own <= v, F.lit(v)) for v in levels]))))
        first, last = (F.expr(f"shiftright(cast({c} as bigint), 3 * __at)") for c in (low, high))
        listed.append(placed.withColumn("__bin", F.explode(F.sequence(first, last))))
    (low, high), (low2, high2) = left_range, right_range
    joined = listed[0].join(listed[1], [key, "__at", "__bin"])
    meets = (F.col(low) <= F.col(high2)) & (F.col(high) >= F.col(low2)) & (F.col("__at") == F.greatest("__level0", "__level1"))
    start = F.greatest(F.col(low), F.col(low2)).cast("long")
    return joined.withColumn("__start", start).filter(meets & (F.col("__bin") == F.expr("shiftright(__start, 3 * __at)"))).drop("__bin", "__at", "__level0", "__level1", "__start")
