"""References to records that don't exist, kept as incremental state per key.

A row of the state is one key: since when its parent is there (``parent_since``, null if it isn't), when it
last came and went (``came_at``, ``deleted_at``), whether it was ever there (``listed``), and the pending
references to it, pre-aggregated to one entry per table, field and month. A step merges a batch of new
references, arrivals, listings, deletions and full deliveries into the state: references probe the key's
parent, arriving parents resolve what waits, deletions reopen it. ``track`` feeds the deliveries of a
history in order, a period at a time. ``report`` reads the orphans of a state, ``counts`` is the periodic
snapshot of their numbers.

Defined results: null keys are no cases; a reference without time has the month ``unknown``, belongs to the
first period and is never late; an entry keeps the earliest time of its month, so it is late if any of its
rows was; a parent that comes and goes in one step is there if it came last, since its last arrival.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veinstone.session import cut

#: Steps in which the deliveries of a history are fed.
PERIODS = 3
#: Most deliveries of a history; a row each on the driver.
MAX_DELIVERIES = 100_000
ENTRY = "struct<src_table:string,src_field:string,ref_month:string,first_at:timestamp>"
STATE_SCHEMA = f"key string, parent_since timestamp, came_at timestamp, deleted_at timestamp, listed boolean, refs array<{ENTRY}>"


@dataclass(frozen=True)
class Reference:
    """One referring column of a batch: table and field as reported (text or expressions), key and time as expressions of df."""

    df: DataFrame
    table: str | Column
    field: str | Column
    key: Column
    at: Column


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE_SCHEMA)


_KINDS = {"parent_since": "timestamp", "came_first": "timestamp", "came_at": "timestamp", "deleted_at": "timestamp", "full_at": "timestamp", "listed": "boolean", "refs": f"array<{ENTRY}>"}


def _events(df: DataFrame, **values: Column) -> DataFrame:
    return df.select("key", *[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in _KINDS.items()]).filter(F.col("key").isNotNull())


def _text(c: str | Column) -> Column:
    return F.lit(c) if isinstance(c, str) else c


def reference_entries(references: Iterable[Reference]) -> DataFrame:
    """One row per table, field, month and key with its earliest time; combined in the tasks, so a hot key stays small."""
    rows = [
        r.df.select(_text(r.table).alias("src_table"), _text(r.field).alias("src_field"), r.key.alias("key"), r.at.cast("timestamp").alias("at"))
        for r in references
    ]
    return (
        reduce(DataFrame.unionByName, rows)
        .filter(F.col("key").isNotNull())
        .withColumn("ref_month", F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown")))
        .groupBy("src_table", "src_field", "ref_month", "key")
        .agg(F.min("at").alias("first_at"))
    )


def step(
    state: DataFrame | None,
    references: Iterable[Reference] = (),
    parents: tuple[DataFrame, Column, Column] | None = None,
    listings: tuple[DataFrame, Column] | None = None,
    deletions: tuple[DataFrame, Column, Column] | None = None,
    full: tuple[DataFrame, Column, Column] | None = None,
) -> DataFrame:
    """The state after a batch. parents and deletions: df, key, time; listings: df, key; full: df, key, time.

    Each input is combined per key in the tasks before the one shuffle that merges them with the state.
    A deletion removes parents that came at its time or before. A full delivery names all parents there are,
    with the times since when: what it lacks is gone, what it names is there since its earliest time.
    """
    parts: list[DataFrame] = []
    if state is not None:
        parts.append(_events(state, **{c: F.col(c) for c in ("parent_since", "came_at", "deleted_at", "listed", "refs")}))
    if references := list(references):
        entry = F.struct("src_table", "src_field", "ref_month", "first_at").cast(ENTRY)
        parts.append(_events(reference_entries(references), refs=F.array(entry)))
    start = F.timestamp_seconds(F.lit(0))
    known = lambda c: F.coalesce(c, start)  # noqa: E731  rows without time count only where none has one
    timed = lambda part, **folds: part[0].select(part[1].alias("key"), part[2].cast("timestamp").alias("at")).groupBy("key").agg(*[known(f).alias(c) for c, f in folds.items()])
    if parents:
        parts.append(_events(timed(parents, first=F.min("at"), last=F.max("at")), came_first=F.col("first"), came_at=F.col("last")))
    if listings:
        df, key = listings
        parts.append(_events(df.select(key.alias("key")).distinct(), listed=F.lit(True)))
    if deletions:
        parts.append(_events(timed(deletions, last=F.max("at")), deleted_at=F.col("last"), listed=F.lit(True)))
    if full:
        parts.append(_events(timed(full, first=F.min("at")), full_at=F.col("first")))
    if not parts:
        raise ValueError("neither a state nor a batch")
    folds = [F.min(c).alias(c) for c in ("parent_since", "came_first", "full_at")] + [F.max(c).alias(c) for c in ("came_at", "deleted_at", "listed")]
    merged = reduce(DataFrame.unionByName, parts).groupBy("key").agg(*folds, F.flatten(F.collect_list("refs")).alias("refs"))
    gone = F.coalesce(F.col("deleted_at") >= F.col("came_at"), F.lit(False))
    again = F.coalesce(F.least("parent_since", "came_first") <= F.col("deleted_at"), F.lit(False))  # away in between
    since = F.when(gone, None).when(again, F.col("came_at")).otherwise(F.least("parent_since", "came_first"))
    return merged.select(
        "key", (F.col("full_at") if full else since).alias("parent_since"), F.greatest("came_at", "full_at").alias("came_at"), "deleted_at",
        (F.coalesce(F.col("listed"), F.lit(False)) | F.coalesce("came_at", "full_at").isNotNull()).alias("listed"), F.expr(_FOLD).alias("refs"),
    )


def transitions(listing: DataFrame, key: Column, delivery: str, deliveries: list[int]) -> DataFrame:
    """key, delivery, arrived: every key's coming (true) and going (false) from one full listing to the next.

    deliveries: the numbers of all listings in order; an array of them per key, so one shuffle of the keys.
    """
    seen = (
        listing.select(key.alias("key"), F.col(delivery).cast("long").alias("d")).filter("key is not null and d is not null")
        .groupBy("key").agg(F.collect_set("d").alias("seen"))
    )
    pairs = F.arrays_zip(F.array(*map(F.lit, deliveries)).alias("d"), F.array(*map(F.lit, [None, *deliveries[:-1]])).cast("array<long>").alias("prior"))
    there, was = (lambda x: F.array_contains("seen", x["d"])), (lambda x: F.coalesce(F.array_contains("seen", x["prior"]), F.lit(False)))
    moved = F.filter(pairs, lambda x: there(x) != was(x))
    return seen.select("key", "seen", F.explode(moved).alias("m")).select("key", F.col("m.d").alias("delivery"), F.array_contains("seen", F.col("m.d")).alias("arrived"))


def track(
    references: Callable[[Column | None, Column | None], list[Reference]],
    listing: tuple[DataFrame, Column, str, str],
    current: tuple[DataFrame, Column, Column],
    periods: int = PERIODS,
    on_state: Callable[[DataFrame, object], None] | None = None,
) -> DataFrame:
    """The state after all deliveries of a history, fed in order.

    listing: df, key, number and time of delivery of the full listings; what the next one lacks is deleted.
    current: df, key, time of the last full delivery. references(after, until) gives the references with a
    time in (after, until]; those without time come with after null, all later ones with until null. The
    deliveries are fed in that many periods at most, each one step; on_state sees the state after each.
    """
    df, key, number, at = listing
    rows = df.filter(F.col(number).isNotNull()).groupBy(number).agg(F.min(at).alias("at")).limit(MAX_DELIVERIES + 1).collect()
    if len(rows) > MAX_DELIVERIES:
        raise ValueError(f"more than {MAX_DELIVERIES} deliveries")
    times, last = [], None
    for r in sorted(rows, key=lambda r: r[0]):
        last = max(x for x in (last, r.at) if x is not None) if (last or r.at) else None
        times.append((int(r[0]), last))
    state: DataFrame | None = None
    after: Column | None = None
    if timed := [t for t in times if t[1] is not None]:
        moves = cut(transitions(df, key, number, [n for n, _ in times]))
        size = -(-len(timed) // max(1, periods))
        known = F.create_map(*[F.lit(x) for pair in times for x in (pair[0], pair[1] or timed[0][1])]) if len(times) <= 1000 else None
        low = None
        for i in range(0, len(timed), size):
            high, until = timed[min(i + size, len(timed)) - 1]
            inside = moves.filter((F.col("delivery") <= high) if low is None else (F.col("delivery") > low) & (F.col("delivery") <= high))
            # time of the delivery; of very many, their number in the order of time
            when = known[F.col("delivery")] if known is not None else F.timestamp_seconds(F.col("delivery"))
            state = cut(step(
                state, references(after, F.lit(until)), parents=(inside.filter("arrived"), F.col("key"), when), deletions=(inside.filter("not arrived"), F.col("key"), when),
            ))
            if on_state is not None:
                on_state(state, until)
            low, after = high, F.lit(until)
    return step(state, references(after, None), full=current)


#: Entries of one table, field and month become one with the earliest time (null only where none has a time).
_FOLD = """
transform(
  array_distinct(transform(refs, r -> named_struct('src_table', r.src_table, 'src_field', r.src_field, 'ref_month', r.ref_month))),
  g -> named_struct('src_table', g.src_table, 'src_field', g.src_field, 'ref_month', g.ref_month, 'first_at',
    array_min(transform(filter(refs, r -> r.src_table = g.src_table and r.src_field = g.src_field and r.ref_month = g.ref_month), r -> r.first_at))))
"""


def report(state: DataFrame) -> DataFrame:
    """src_table, src_field, ref_month, key, orphan_kind of the references that are orphans in this state."""
    ref = F.explode("refs").alias("ref")
    rows = state.select("key", "parent_since", "listed", ref)
    kind = (
        F.when(F.col("parent_since").isNotNull(), F.when(F.col("parent_since") > F.col("ref.first_at"), F.lit("late")))
        .when(F.col("listed"), F.lit("deleted"))
        .otherwise(F.lit("missing"))
    )
    return rows.select("ref.src_table", "ref.src_field", "ref.ref_month", "key", kind.alias("orphan_kind")).filter(F.col("orphan_kind").isNotNull())


def counts(state: DataFrame) -> DataFrame:
    """The periodic snapshot: how many keys are orphans per table, field, month and kind."""
    return report(state).groupBy("src_table", "src_field", "ref_month", "orphan_kind").agg(F.count("*").alias("n_keys"))
