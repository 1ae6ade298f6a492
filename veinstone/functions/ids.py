"""Canonical function ids and other key expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_id(c: Column | str) -> Column:
    """``path::name`` with forward slashes, no leading ``./`` and no outer blanks; null stays null."""
    plain = F.translate(F.btrim(_col(c), F.lit(" \t")), "\\", "/")
    return F.when(plain.startswith("./"), F.regexp_replace(plain, r"^(?:\./)+", "")).otherwise(plain)


def id_path(c: Column | str) -> Column:
    """What stands before the first ``::``."""
    return F.substring_index(_col(c), "::", 1)


def id_name(c: Column | str) -> Column:
    """What stands after the first ``::``; null if there is none."""
    return F.get(F.split(_col(c), "::", 2), F.lit(1))


def valid_id(c: Column | str) -> Column:
    """True where the id has both parts, split once at the first ``::``."""
    parts = F.split(_col(c), "::", 2)
    return (F.size(parts) == 2) & (F.length(parts[0]) > 0) & (F.length(F.get(parts, F.lit(1))) > 0)


def key128(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the columns, together a compact key."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("k2"), *cols)
