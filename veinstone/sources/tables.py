"""Reading the project's tables and the current rows of versioned ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Table name of the directory, lazily; Catalyst prunes columns and pushes filters to the scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def current_rows(df: DataFrame, key: Column | str, order: str = "updated_at") -> DataFrame:
    """The row with the greatest order for each key, nulls last; rows without key go.

    Equal rows stand for one; rows that tie but differ are settled by the hash of all columns, so
    repeated runs agree. row_number() = 1 becomes a group limit before the shuffle, hence a key that
    holds a third of all rows sends one row per task.
    """
    key_col = F.col(key) if isinstance(key, str) else key
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith(("map", "variant"))])
    window = Window.partitionBy("__key").orderBy(F.col(order).desc_nulls_last(), F.col("__tie"))
    return (
        df.withColumns({"__key": key_col, "__tie": hashed})
        .filter(F.col("__key").isNotNull())
        .withColumn("__rank", F.row_number().over(window))
        .filter(F.col("__rank") == 1)
        .drop("__key", "__tie", "__rank")
    )
