"""Changes of keyed tables as transforms from (table, delta) to the next version of the table.

Each is one shuffle on the key; the store writes the result as a new version. Defined results: delta rows
with a null key go; repeated delta rows stand for one, the greatest by order if they differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from veinstone.session import broadcast_if_small

from veinstone.session import cut


def _one_per_key(delta: DataFrame, keys: Sequence[str], order: str | None) -> DataFrame:
    for k in keys:
        delta = delta.filter(F.col(k).isNotNull())
    if order is None:
        return delta.dropDuplicates(list(keys))
    best = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.xxhash64(*delta.columns))
    return delta.withColumn("__r", F.row_number().over(best)).filter("__r = 1").drop("__r")


def upsert(table: DataFrame, delta: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Rows of delta replace those of table by key; the columns keep stay as they were where a row existed."""
    new = _one_per_key(delta, keys, order).select(*table.columns)
    old = table.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in keep], F.lit(True).alias("__had"))
    merged = new.join(old, list(keys), "left")
    fixed = [F.when(F.col("__had"), F.col(f"__old_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in table.columns]
    return merged.select(*fixed).unionByName(table.join(new.select(*keys), list(keys), "left_anti"))


def insert_ignore(table: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of delta with new keys are added, others ignored."""
    new = _one_per_key(delta, keys, None).select(*table.columns)
    return table.unionByName(new.join(table.select(*keys), list(keys), "left_anti"))


def classify(table: DataFrame, delta: DataFrame, keys: Sequence[str], hash_column: str, order: str | None = None) -> DataFrame:
    """keys and outcome (``new``, ``changed``, ``unchanged``, ``absent``) by comparing hashes, nulls equal."""
    new = _one_per_key(delta, keys, order).select(*keys, F.col(hash_column).alias("__new"), F.lit(True).alias("__in_new"))
    old = table.select(*keys, F.col(hash_column).alias("__old"), F.lit(True).alias("__in_old"))
    outcome = (
        F.when(F.col("__in_old").isNull(), "new").when(F.col("__in_new").isNull(), "absent")
        .when(F.col("__new").eqNullSafe(F.col("__old")), "unchanged").otherwise("changed")
    )
    return new.join(old, list(keys), "full").select(*keys, outcome.alias("outcome"))


def merge_changed(table: DataFrame, delta: DataFrame, keys: Sequence[str], hash_column: str, keep: Sequence[str], order: str | None = None) -> DataFrame:
    """Like upsert, but rows whose hash is the same stay untouched."""
    new = _one_per_key(delta, keys, order)
    same = table.select(*keys, F.col(hash_column).alias("__old"))
    moved = new.join(same, list(keys), "left").filter(F.col("__old").isNull() | ~F.col(hash_column).eqNullSafe(F.col("__old"))).drop("__old")
    return upsert(table, moved, keys, keep)


def update_where(table: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """Columns change where condition is true; false and null leave them."""
    hit = F.coalesce(condition, F.lit(False))
    return table.withColumns({c: F.when(hit, value).otherwise(F.col(c)) for c, value in changes.items()})


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """Rows go where condition is true."""
    return table.filter(~F.coalesce(condition, F.lit(False)))


def claim_first(table: DataFrame, eligible: Column, order: Sequence[Column], key: str, changes: dict[str, Column], n: int = 1) -> DataFrame:
    """The table after its first n eligible rows were changed, with the column claimed; one writer at a time."""
    first = table.filter(eligible).orderBy(*order).limit(n).select(F.col(key).alias("__k"))
    marked = table.join(broadcast_if_small(first), table[key] == F.col("__k"), "left").withColumn("claimed", F.col("__k").isNotNull()).drop("__k")
    return marked.withColumns({c: F.when(F.col("claimed"), value).otherwise(F.col(c)) for c, value in changes.items()})


def with_ids(table: DataFrame, delta: DataFrame, id_column: str) -> DataFrame:
    """delta with ids that follow the table's greatest one, without gaps.

    Rows are numbered within their partitions; the driver adds up one count per partition, and no task sees all rows.
    """
    marked = cut(delta.withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit(2**33 - 1))
    top = table.agg(F.max(id_column).alias("top")).head().top or 0
    starts: list[tuple[int, int]] = []
    for r in sorted(marked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect(), key=lambda r: r.part):
        starts.append((r.part, top + 1))
        top += r.n
    offsets = F.broadcast(delta.sparkSession.createDataFrame(starts, "__part long, __start long"))  # one row per partition
    return marked.withColumn("__part", part).join(offsets, "__part").withColumn(id_column, F.col("__start") + place).drop("__at", "__part", "__start")
