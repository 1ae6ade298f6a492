"""Clashing names, ties, repeated rows and long keys for the general operators."""

from pyspark.sql import functions as F

from veinstone.operators import hierarchy, nested, orphans, snapshots
from veinstone.sources.tables import current_rows

CLASH = ["*", *"'x' as id, 1L as k1, 2L as k2, 3 as bucket, 'y' as key, array(1) as refs, 'z' as tree, 'w' as root, 'v' as document, 'd' as doc_id, 9 as scan_no, 'q' as fetch".split(", ")]


def test_nested(spark):
    df = spark.createDataFrame([("a", '{"l": [{"x": 1}, {"x": 1}]}'), ("a", '{"l": [{"x": 1}, {"x": 1}]}')], "name string, body string").selectExpr(*CLASH)
    rows = nested.shred(df, "name", "body").nodes.filter("in_list").collect()
    assert sorted(r.node_path for r in rows) == ["$.l[0]", "$.l[0]", "$.l[1]", "$.l[1]"]
    assert current_rows(df.withColumn("updated_at", F.lit(1)), "name").count() == 1
    big = '{"l": [' + ",".join('{"x": "' + "y" * 50 + '"}' for _ in range(50_000)) + "]}"
    assert nested.shred(spark.createDataFrame([("a", big)], "name string, body string"), "name", "body", with_fields=False).nodes.count() == 50_001


def test_snapshots(spark):
    df = spark.createDataFrame([(1, "a" * 100_000, "v", 1), (2, "a" * 100_000, "w", 1), (2, "a" * 100_000, "w", 1)], "s int, name string, v string, t int").withColumn("t", F.timestamp_seconds("t"))
    got = snapshots.snapshot_changes(df.selectExpr(*CLASH), "s", F.col("name"), F.col("v"), "t").collect()
    assert [(r.scan_no, r.change_type, len(r.key)) for r in got] == [(2, "changed", 100_000)]


def test_hierarchy(spark):
    df = spark.createDataFrame([("b" * 50_000, "a"), ("b" * 50_000, "a"), ("a", None)], "node string, parent string").selectExpr(*CLASH, "1 as depth", "2 as enter")
    assert sorted((len(r.node), r.depth) for r in hierarchy.hierarchy(df).collect()) == [(1, 0), (50_000, 1)]


def test_orphans(spark):
    df = spark.createDataFrame([("k" * 50_000, 1), ("k" * 50_000, 1), ("", 2)], "name string, t int").withColumn("t", F.timestamp_seconds("t")).selectExpr(*CLASH, "1 as listed", "2 as parent_since")
    state = orphans.step(None, [orphans.Reference(df, "t", "f", F.col("name"), F.col("t"))], parents=(df.filter("name = ''"), F.col("name"), F.col("t")))
    assert [(len(r.key), r.orphan_kind) for r in orphans.report(state).collect()] == [(50_000, "missing")]
