"""Commits of a git repository as a table. The driver lists their names; the tasks read messages and diffs, which stay text.

The repository's folder must be one that all executors see. A commit that git can't show is left out of the tables,
as the merge of a cut history may be.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from veinstone.operators.mining import bug_fix_score

_FIELDS = "commit_sha string, author string, committed_at string, message string, diff string"


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout.decode("utf-8", "replace")


def list_commits(repo: str, start: str | None, end: str = "HEAD") -> list[str]:
    """Names of the commits after start up to end, oldest first: 40 characters each."""
    return _git(repo, "rev-list", "--reverse", f"{start}..{end}" if start else end, "--").split()


def read_commit(repo: str, sha: str) -> tuple[str, str, str, str, str]:
    """A commit with its diff; one without parent is compared with the empty tree."""
    author, at, message = _git(repo, "log", "-1", "--format=%an%x00%aI%x00%B", sha).split("\0", 2)
    return sha, author, at, message.strip(), _git(repo, "show", "--format=", "--no-color", "-m", "--first-parent", sha)


def commits(spark: SparkSession, repo: str, start: str | None = None, end: str = "HEAD", bug_fixes_only: bool = False) -> DataFrame:
    """The commits with bug_fix_score; bug_fixes_only keeps scores of at least 0.3."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _FIELDS.split(", ")]
        for batch in batches:
            for sha in batch.column(0).to_pylist():  # a batch each: diffs may be large
                try:
                    row = read_commit(repo, sha)
                except subprocess.CalledProcessError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in row], names=names)

    shas = spark.createDataFrame([(sha,) for sha in list_commits(repo, start, end)], "commit_sha string")
    rows = shas.mapInArrow(run, _FIELDS).withColumn("committed_at", F.to_timestamp("committed_at")).withColumn("bug_fix_score", bug_fix_score(F.col("message")))
    return rows.filter("bug_fix_score >= 0.3") if bug_fixes_only else rows
