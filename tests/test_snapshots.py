import random

from pyspark.sql import functions as F

from veinstone.operators.snapshots import snapshot_changes

SCHEMA = "scan int, key string, v string, at timestamp"


def brute(rows):
    scans = sorted({r[0] for r in rows if r[0] is not None})
    best = {}
    for s, k, v, at in rows:
        if s is not None and k is not None and ((s, k) not in best or (at or "") > best[s, k][0]):
            best[s, k] = (at or "", v)
    out = set()
    for p, s in zip(scans, scans[1:]):
        old = {k: v for (x, k), (_, v) in best.items() if x == p}
        new = {k: v for (x, k), (_, v) in best.items() if x == s}
        out |= {(s, k, "added") for k in new.keys() - old.keys()} | {(s, k, "removed") for k in old.keys() - new.keys()}
        out |= {(s, k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "scan int, key string, v string, at string").withColumn("at", F.col("at").cast("timestamp"))


def run(spark, rows, **more):
    got = snapshot_changes(frame(spark, rows), "scan", F.col("key"), F.col("v"), "at", **more).collect()
    assert len({(r.scan_no, r.key) for r in got}) == len(got)
    return got


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        at = f"2024-01-01 00:{i // 60 % 60:02d}:{i % 60:02d}" if rng.random() > 0.02 else None
        rows.append((rng.choice([1, 2, 4, 9]), f"k{rng.randrange(150)}" if rng.random() > 0.03 else None, rng.choice(["a", "b", None]), at))
    # times are different for each row of a key but for nulls, which lose
    seen, clean = set(), []
    for r in rows:
        if (r[0], r[1], r[3]) not in seen:
            seen.add((r[0], r[1], r[3]))
            clean.append(r)
    got = run(spark, clean, buckets=7)
    assert {(r.scan_no, r.key, r.change_type) for r in got} == brute(clean)
    wide = run(spark, clean, buckets=3, with_values=True)
    assert {(r.scan_no, r.key, r.change_type) for r in wide} == brute(clean)
    assert all(r.old_value != r.new_value for r in wide if r.change_type == "changed")


def test_null_value_is_a_value_and_an_empty_scan_counts(spark):
    rows = [(1, "a", None, None), (1, "b", "", None), (2, None, "x", None), (3, "a", None, None), (3, "b", None, None)]
    assert {(r.scan_no, r.key, r.change_type) for r in run(spark, rows)} == {(2, "a", "removed"), (2, "b", "removed"), (3, "a", "added"), (3, "b", "added")}


def test_first_scan_empty_table_and_hot_key(spark):
    assert run(spark, [(1, "a", "x", None)]) == []
    assert run(spark, [(None, "a", "x", None)]) == []
    hot = [(s, "hot", str(s), f"2024-01-01 00:00:{i % 60:02d}") for s in (1, 2) for i in range(2000)] + [(1, "c", "x", None), (2, "c", "x", None)]
    assert [(r.key, r.change_type) for r in run(spark, hot)] == [("hot", "changed")]


def test_ties_agree_between_runs(spark):
    rows = [(1, "a", "x", "2024-01-01 00:00:00")] + [(2, "a", v, "2024-01-01 00:00:00") for v in ("x", "y", "z")]
    first = [(r.key, r.change_type) for r in run(spark, rows)]
    assert first == [(r.key, r.change_type) for r in run(spark, rows[::-1], buckets=2)]
