"""Lookups, filtered pages, searches and joins over the catalogue.

Every operator maps DataFrames to DataFrames; sorts name a full key, so pages are the same in every run,
and end in a limit that Spark answers without a global sort. Defined results: null keys match nothing;
nulls sort last in both directions; an empty search or id list finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from veinstone.session import broadcast_if_small


def ordered(df: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """df sorted by (column, asc or desc), nulls last."""
    return df.orderBy(*[F.col(c).asc_nulls_last() if way == "asc" else F.col(c).desc_nulls_last() for c, way in keys])


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The rows whose key is value; the filter reaches the Parquet scan."""
    return df.filter(F.col(key) == F.lit(value))


def lookup_many(df: DataFrame, key: str, wanted: DataFrame | Iterable[object]) -> DataFrame:
    """The rows whose key is among wanted (a list, or a frame with the column key); missing ones are left out."""
    if isinstance(wanted, DataFrame):
        return df.join(broadcast_if_small(wanted.select(key).distinct()), key, "left_semi")
    return df.filter(F.col(key).isin(list(wanted)))


def where_all(df: DataFrame, equal: dict[str, object] | None = None, like: dict[str, str] | None = None, at_least: dict[str, Column] | None = None) -> DataFrame:
    """Conjunction of the conditions that are given; None leaves one out. like takes patterns as they are, with ``_`` and ``%``."""
    for column, value in (equal or {}).items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    for column, pattern in (like or {}).items():
        if pattern is not None:
            df = df.filter(F.col(column).like(pattern))
    for column, value in (at_least or {}).items():
        if value is not None:
            df = df.filter(F.col(column) >= value)
    return df


def page(df: DataFrame, keys: Sequence[tuple[str, str]], limit: int, offset: int = 0) -> DataFrame:
    """One page in the order of keys."""
    out = ordered(df, keys)
    return (out.offset(offset) if offset else out).limit(limit)


def page_with_total(df: DataFrame, keys: Sequence[tuple[str, str]], limit: int, offset: int = 0) -> DataFrame:
    """The page with total (rows of df) and has_more; the count is a scalar subquery."""
    total = df.agg(F.count("*").alias("total")).scalar()
    return page(df, keys, limit, offset).withColumn("total", total).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def search(df: DataFrame, pattern: str, name: str, key: str, limit: int) -> DataFrame:
    """Rows whose name starts with or whose key contains pattern, exact names first."""
    if not pattern:
        return df.limit(0)
    hits = df.filter(F.col(name).like(f"{pattern}%") | F.col(key).like(f"%{pattern}%"))
    ranked = hits.withColumn("__rank", F.when(F.col(name) == pattern, 0).otherwise(1))
    return page(ranked, [("__rank", "asc"), (name, "asc"), (key, "asc")], limit).drop("__rank")


def similar(df: DataFrame, name_part: str, path_part: str, name: str, path: str, key: str, limit: int, either_way: bool = False) -> DataFrame:
    """Suggestions in two tiers: names that contain name_part (or, either_way, are contained in it), then paths that contain path_part."""
    near = F.contains(F.lower(F.col(name)), F.lit(name_part.lower()))
    if either_way:
        near = near | F.contains(F.lit(name_part.lower()), F.lower(F.col(name)))
    far = F.contains(F.lower(F.col(path)), F.lit(path_part.lower()))
    tier = F.when(near, 0).when(far, 1)
    return page(df.withColumn("tier", tier).filter(F.col("tier").isNotNull()), [("tier", "asc"), (key, "asc")], limit)


def with_existence(df: DataFrame, other: DataFrame, key: str, flag: str) -> DataFrame:
    """df with flag: whether other has a row of the same key; other is reduced to its distinct keys first."""
    keys = other.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    return df.join(keys, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def limit_then_filter(df: DataFrame, keys: Sequence[tuple[str, str]], limit: int, condition: Column) -> DataFrame:
    """The rows of the first page that meet condition: the filter stays behind the limit."""
    return page(df, keys, limit).filter(condition)


def list_size(document: Column | str, path: str) -> Column:
    """Elements of the list at a key of a JSON text; 0 for bad JSON, no such key, or no list."""
    document = F.col(document) if isinstance(document, str) else document
    items = F.try_variant_get(F.try_parse_json(document), f"$.{path}", "array<variant>")
    return F.when(items.isNull(), 0).otherwise(F.size(items))


def text_field(document: Column | str, path: str) -> Column:
    """The text at a key of a JSON text; null for bad JSON or anything but a text."""
    document = F.col(document) if isinstance(document, str) else document
    return F.try_variant_get(F.try_parse_json(document), f"$.{path}", "string")


def shortened(text: Column, size: int) -> Column:
    """The first size characters with an ellipsis if there are more."""
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)
