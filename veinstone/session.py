"""Session settings, checkpoints and size checks shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Largest number of bytes, by Spark's own estimate, that an operator may broadcast by hint.
BROADCAST_BYTES = 32 * 1024 * 1024


def build_session(app: str = "veinstone", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the engine is written for; what the cluster sets already stays."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | (conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once per session, so that Python workers find it wherever they start."""
    context = spark.sparkContext
    if getattr(context, "_veinstone_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):  # else it runs from an archive, which was sent already
        archive = os.path.join(tempfile.mkdtemp(prefix="veinstone-"), "veinstone.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, files in os.walk(root):
                for name in files:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(root)))
        context.addPyFile(archive)  # Spark's own file server hands it to the executors
    context._veinstone_shipped = True
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; one of our own only where none is set and all runs in one process, as in tests."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="veinstone-checkpoint-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept as a reliable checkpoint, which outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def estimated_bytes(df: DataFrame) -> int:
    """Spark's upper estimate of the size of df, without running it; at most 2 ** 62."""
    try:
        return min(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), 2**62)
    except ValueError:  # a product of joins with thousands of digits
        return 2**62


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its estimated size is within limit, else df as it is (Spark then shuffles)."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def join_spread(rows: DataFrame, small: DataFrame, key: str, by: str, salts: int = 64) -> DataFrame:
    """rows joined with small (one row per key) on key, where one key may hold a large part of all rows.

    A small side within the limit is broadcast. Else the rows of a key are divided by the hash of the column by, and
    small is first given to those (key, salt) that occur: at most salts rows of it per key, none that isn't needed.
    """
    from pyspark.sql import functions as F

    if estimated_bytes(small) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), key)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    return salted.join(salted.select(key, "__salt").distinct().join(small, key), [key, "__salt"]).drop("__salt")
