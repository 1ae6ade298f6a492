"""Histograms, roll-ups and ranks; each in one aggregation with partial results in the tasks.

Defined results: averages and shares of nothing are null; counts of nothing are 0; nulls belong to no bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def float_lit(value: float) -> Column:
    """A 32-bit literal: compared with a float column, 0.7 is 0.7."""
    return F.lit(value).cast("float")


def unit_score(value: str) -> Column:
    """A score as a share: what is above 1 is a percentage."""
    col = F.col(value).cast("double")
    return F.when(col > 1, col / 100).otherwise(col).cast("float")


def rates(counts: DataFrame) -> DataFrame:
    """counts (total and n_verified, n_needs_review, n_pending, n_stale, n_broken) with completion_rate, success_rate and actionable; rates of nothing are 0."""
    share = lambda n: F.round(F.coalesce(F.try_divide(n, F.col("total")), F.lit(0.0)), 4)
    return counts.withColumns({
        "completion_rate": share(F.col("n_verified")), "success_rate": share(F.col("n_verified") + F.col("n_needs_review")),
        "actionable": F.col("n_pending") + F.col("n_stale") + F.col("n_needs_review") + F.col("n_broken"),
    })


def buckets(df: DataFrame, value: str, edges: Sequence[float], names: Sequence[str]) -> DataFrame:
    """One row: average (times 100) of a float column and the rows in each of len(edges) + 1 half-open buckets."""
    col, bounds = F.col(value), [None, *edges, None]
    sums = []
    for name, low, high in zip(names, bounds, bounds[1:]):
        inside = F.lit(True) if low is None else col >= float_lit(low)
        inside = inside if high is None else inside & (col < float_lit(high))
        sums.append(F.coalesce(F.sum(F.when(inside & col.isNotNull(), 1).otherwise(0)), F.lit(0)).alias(name))
    return df.agg(F.count("*").alias("total"), F.round(F.avg(col.cast("double")) * 100, 1).alias("average"), *sums)


def levels(df: DataFrame, value: str, bounds: Sequence[tuple[str, float]], rest: str) -> DataFrame:
    """level, n for every level, also those without rows; bounds go from the highest down."""
    case = F.when(F.col(value) >= float_lit(bounds[0][1]), bounds[0][0])
    for name, low in bounds[1:]:
        case = case.when(F.col(value) >= float_lit(low), name)
    counted = df.filter(F.col(value).isNotNull()).groupBy(case.otherwise(rest).alias("level")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(n,) for n in [*[b[0] for b in bounds], rest]], "level string")
    return every.join(counted, "level", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def top_k(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), *[F.col(c).asc_nulls_last() for c in columns]).limit(k)


def pivot_counts(df: DataFrame, column: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """total and one count per value, for all rows or for each group."""
    sums = [F.coalesce(F.sum(F.when(F.col(column) == v, 1).otherwise(0)), F.lit(0)).alias(f"n_{v.lower()}") for v in values]
    return (df.groupBy(*by) if by else df).agg(F.count("*").alias("total"), *sums)


def kth_largest(df: DataFrame, value: Column, ratio: float, default: int, highest: int = 100) -> DataFrame:
    """One row, threshold: the least value of the best int(ratio * n) rows, from counts per distinct integer value.

    default if there are no rows; one more than the largest value (at most highest) if the ratio picks none.
    """
    counted = df.select(value.cast("int").alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    # one row per distinct value: as many as the value has integers, not as the table has rows
    folded = counted.agg(F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("v"), "n"))).alias("a"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    wanted = F.floor(F.col("n") * F.lit(ratio)).cast("long")
    reach = F.aggregate(
        "a", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("hit")),
        lambda s, x: F.struct(
            (s["seen"] + x["n"]).alias("seen"),
            F.when(s["hit"].isNull() & (s["seen"] + x["n"] >= wanted), -x["v"]).otherwise(s["hit"]).alias("hit"),
        ),
        lambda s: s["hit"],
    )
    largest = -F.get("a", F.lit(0))["v"]
    return folded.select(
        F.when(F.col("n") == 0, F.lit(default)).when(wanted < 1, F.least(largest + 1, F.lit(highest))).otherwise(reach).cast("int").alias("threshold")
    )


def newest_per_key(df: DataFrame, key: str, order: str, tie: str, n: int) -> DataFrame:
    """The newest n rows of each key; the group limit acts before the shuffle too."""
    window = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), F.col(tie).desc_nulls_last())
    return df.filter(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(window)).filter(F.col("__n") <= n).drop("__n")


def adjusted(scores: DataFrame, findings: DataFrame, key: str, base: str, weight: Column, is_open: Column) -> DataFrame:
    """scores (one row per key) with penalty, adjusted and n_open: the base less the weights of the key's open findings, at least 0.

    The findings are summed per key before they meet the scores; a key without findings keeps its base.
    """
    summed = findings.filter(is_open & F.col(key).isNotNull()).groupBy(key).agg(F.coalesce(F.sum(weight), F.lit(0)).alias("__sum"), F.count("*").alias("n_open"))
    joined = scores.join(summed, key, "left").withColumns({"__sum": F.coalesce("__sum", F.lit(0)), "n_open": F.coalesce("n_open", F.lit(0))})
    lowered = joined.withColumn("adjusted", F.greatest(F.lit(0), F.col(base) - F.col("__sum")))
    return lowered.withColumn("penalty", F.col(base) - F.col("adjusted")).drop("__sum")


def penalised(df: DataFrame, key: str, weights: Column, base: int) -> DataFrame:
    """key, penalty, remaining: the base less the sum of weights, at least 0."""
    return df.groupBy(key).agg(F.coalesce(F.sum(weights), F.lit(0)).alias("penalty")).withColumn("remaining", F.greatest(F.lit(0), F.lit(base) - F.col("penalty")))
