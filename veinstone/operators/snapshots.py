"""What changed between consecutive full snapshots of a table.

Keys and values travel as 64-bit hashes only. Tasks drop repeated rows of a batch, hash buckets of the keys
are compared in numpy (sorted arrays, searchsorted set differences), and full keys and values are fetched
for the differences alone: each names the rows that hold them, the scan of the table is reduced to these
rows (by a broadcast where the differences are few enough, else by a join), and only what is left is shuffled.

Defined results: within a scan the row with the greatest order counts (null order last; a tie between
different values is settled by their hash); rows without key or scan don't count, yet a scan whose rows all
lack a key is a delivered, empty one; null is a value of its own; the first scan yields nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veinstone.functions.ids import key128
from veinstone.session import BROADCAST_BYTES, cut

#: Most different scans whose numbers are sent to the tasks (8 bytes each).
MAX_SCANS = 1_000_000
#: Rows of one bucket on average, which one task holds as arrays of 40 bytes a row.
BUCKET_ROWS = 1_000_000
CHANGES = ("added", "removed", "changed")
_COLUMNS = ("scan", "k1", "k2", "at", "value")


def _best(scan: np.ndarray, k1: np.ndarray, k2: np.ndarray, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """The row with the greatest (at, value) of each (k1, k2, scan), sorted by these."""
    order = np.lexsort((value, at, scan, k2, k1))
    scan, k1, k2, at, value = (a[order] for a in (scan, k1, k2, at, value))
    last = np.ones(len(scan), bool)
    last[:-1] = (scan[1:] != scan[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    return tuple(a[last] for a in (scan, k1, k2, at, value))


def _arrays(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy() for c in _COLUMNS)


def compare_bucket(scan: np.ndarray, k1: np.ndarray, k2: np.ndarray, at: np.ndarray, value: np.ndarray, scans: np.ndarray) -> tuple[np.ndarray, ...]:
    """scan, scan before it, k1, k2, code of CHANGES for every difference between neighbours in scans."""
    scan, k1, k2, _, value = _best(scan, k1, k2, at, value)
    new_key = np.ones(len(scan), bool)
    new_key[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    key = np.cumsum(new_key) - 1  # dense: equal only where both hashes are
    firsts = np.flatnonzero(new_key)
    rank = np.searchsorted(scans, scan)
    by_scan = np.argsort(rank, kind="stable")  # keys stay ascending within a scan
    edges = np.searchsorted(rank[by_scan], np.arange(len(scans) + 1))
    found: list[tuple[np.ndarray, int, int]] = []
    before_key, before_value = key[by_scan[edges[0] : edges[1]]], value[by_scan[edges[0] : edges[1]]]
    for i in range(1, len(scans)):
        rows = by_scan[edges[i] : edges[i + 1]]
        now_key, now_value = key[rows], value[rows]
        at_before = np.searchsorted(before_key, now_key)
        if len(before_key):
            there = before_key[np.minimum(at_before, len(before_key) - 1)] == now_key
            there &= at_before < len(before_key)
            back = np.minimum(np.searchsorted(now_key, before_key), max(len(now_key) - 1, 0))
            kept = now_key[back] == before_key if len(now_key) else np.zeros(len(before_key), bool)
        else:
            there, kept = np.zeros(len(now_key), bool), np.zeros(0, bool)
        changed = there.copy()
        changed[there] = now_value[there] != before_value[at_before[there]]
        for code, keys in ((0, now_key[~there]), (1, before_key[~kept]), (2, now_key[changed])):
            if len(keys):
                found.append((keys, i, code))
        before_key, before_value = now_key, now_value
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    keys = np.concatenate([f[0] for f in found])
    spread = lambda k: np.concatenate([np.full(len(f[0]), f[k], np.int64) for f in found])
    return scans[spread(1)], scans[spread(1) - 1], k1[firsts][keys], k2[firsts][keys], spread(2)


def bucket_count(df: DataFrame, rows: int) -> int:
    """Buckets for a table of so many rows: BUCKET_ROWS each, yet four for each shuffle partition, so that hot partitions can be spread."""
    return max(4 * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-rows // BUCKET_ROWS))


def _rows_of(source: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """The rows of source that wanted names by k1, k2 and scan (each once); 32 bytes a row decide whether wanted is broadcast."""
    return source.join(F.broadcast(wanted) if 32 * n_wanted <= BROADCAST_BYTES else wanted, ["k1", "k2", "scan"])


def snapshot_changes(
    df: DataFrame,
    scan: str,
    key: Column,
    value: Column,
    order: str,
    buckets: int | None = None,
    with_values: bool = False,
) -> DataFrame:
    """scan_no, key, change_type for every key that was added, removed or changed from one scan to the next.

    key is compared as it is, value too (normalise both in the expressions given). with_values adds
    old_value and new_value, fetched for the differing keys alone. A key that holds a third of all rows
    leaves each task with one row per scan and batch; buckets divide the rest by hash.
    """
    source = df.select(
        F.col(scan).cast("long").alias("scan"), key.alias("key"), value.alias("full_value"),
        F.coalesce(F.unix_micros(F.col(order).cast("timestamp")), F.lit(-(2**63))).alias("at"),
    ).filter(F.col("scan").isNotNull())
    listed = source.groupBy("scan").agg(F.count("*").alias("n")).limit(MAX_SCANS + 1).collect()
    if len(listed) > MAX_SCANS:
        raise ValueError(f"more than {MAX_SCANS} different scans")
    scans = np.array(sorted(r.scan for r in listed), np.int64)
    source = source.filter(F.col("key").isNotNull()).withColumns(dict(zip(("k1", "k2"), key128(F.col("key")))))
    hashed = source.select("scan", "k1", "k2", "at", F.xxhash64(F.col("full_value").isNull(), "full_value").alias("value"))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in _best(*_arrays(batch))], names=list(_COLUMNS))

    def differ(table: pa.Table) -> pa.Table:
        found = compare_bucket(*_arrays(table), scans)
        return pa.table(dict(zip(("scan_no", "prior", "k1", "k2", "code"), (pa.array(a) for a in found))))

    n = buckets or bucket_count(df, sum(r.n for r in listed))
    changes = cut(
        hashed.mapInArrow(thin, "scan long, k1 long, k2 long, at long, value long")
        .groupBy(F.pmod("k1", F.lit(n)).alias("bucket"))
        .applyInArrow(differ, "scan_no long, prior long, k1 long, k2 long, code long")
    )
    named = F.element_at(F.array(*[F.lit(c) for c in CHANGES]), (F.col("code") + 1).cast("int"))
    is_new, is_old = F.col("code") != 1, F.col("code") != 0
    # one row that holds the full key of each differing key
    holder = F.when(is_new, F.col("scan_no")).otherwise(F.col("prior"))
    holders = cut(changes.groupBy("k1", "k2").agg(F.min(holder).alias("scan")))
    held = _rows_of(source.select("k1", "k2", "scan", "key"), holders, holders.count())
    keys = held.groupBy("k1", "k2").agg(F.min("key").alias("key"))
    if not with_values:
        return changes.join(keys, ["k1", "k2"]).select("scan_no", "key", named.alias("change_type"))
    sides = F.array(F.when(is_new, F.col("scan_no")), F.when(is_old, F.col("prior")))
    wanted = cut(changes.select("k1", "k2", F.explode(sides).alias("scan")).filter("scan is not null").distinct())
    best = _rows_of(source.select("k1", "k2", "scan", "at", "full_value"), wanted, wanted.count()).groupBy("k1", "k2", "scan").agg(
        F.max(F.struct("at", F.xxhash64(F.col("full_value").isNull(), "full_value").alias("value"), "full_value")).alias("best")
    )
    # the values of a key are as many as its differing scans: they meet its changes in the one shuffle by key
    values = best.select("k1", "k2", "scan", F.col("best.full_value").alias("value"))
    at_new = values.withColumnsRenamed({"scan": "scan_no", "value": "new_value"})
    at_old = values.withColumnsRenamed({"scan": "prior", "value": "old_value"})
    return (
        changes.join(at_new, ["k1", "k2", "scan_no"], "left").join(at_old, ["k1", "k2", "prior"], "left").join(keys, ["k1", "k2"])
        .select("scan_no", "key", named.alias("change_type"), "old_value", "new_value")
    )
