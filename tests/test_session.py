import os

from pyspark.sql import functions as F

from veinstone.session import broadcast_if_small, cut, ensure_checkpoint_dir, estimated_bytes, ship


def test_checkpoints_and_shipping(spark):
    assert ship(spark) is spark and ship(spark) is spark
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    assert ensure_checkpoint_dir(spark).removeprefix("file:") == folder and os.path.isdir(folder)
    kept = cut(spark.range(10).withColumn("x", F.rand()))
    assert kept.collect() == kept.collect()


def test_broadcast_only_behind_a_size(spark):
    small = spark.range(3)
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "UnresolvedHint" in df._jdf.queryExecution().logical().toString()
    assert estimated_bytes(small) == 24
    assert hinted(broadcast_if_small(small)) and not hinted(broadcast_if_small(small, 8))
    huge = spark.range(2**40)
    for _ in range(6):
        huge = huge.join(huge.withColumnRenamed("id", f"id{_}"), F.lit(1) == F.lit(1))
    assert estimated_bytes(huge) == 2**62
