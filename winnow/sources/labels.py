"""The latest label of each path: a snapshot of the override log, and the tail of entries that came after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions
from .files import OVERRIDE, read_overrides

#: A snapshot holds labels, one row a path, and the log files they came from (kind 'file').
SNAPSHOT = "kind string, path string, user_decision string, timestamp timestamp"


def _entries(spark: SparkSession, log: str, names: list[str]) -> DataFrame:
    """Entries of those files of the log."""
    if not names:
        return spark.createDataFrame([], OVERRIDE)
    return read_overrides(spark, [f"{log}/{n}" for n in names])


def _tail(spark: SparkSession, log: str, snapshot: DataFrame | None) -> tuple[list[str], list[str]]:
    """(names of the log's files that a snapshot covers, those it does not)."""
    covered = set() if snapshot is None else {r.path for r in snapshot.where("kind = 'file'").select("path").collect()}  # names of files, no entries
    there = [n for n in versions.names(spark, log) if not n.startswith(("_", "."))]
    return sorted(covered), [n for n in there if n not in covered]


def _latest(rows: DataFrame) -> DataFrame:
    """One row for each path: the label given last; of labels given at the same time the greatest name."""
    best = rows.where("path is not null").groupBy("path").agg(F.max(F.struct(F.col("timestamp"), F.col("user_decision"))).alias("e"))
    return best.select("path", F.col("e.user_decision").alias("user_decision"), F.col("e.timestamp").alias("timestamp"))


def current(spark: SparkSession, log: str, root: str) -> DataFrame:
    """(path, user_decision, timestamp): the latest label of each path, from the last snapshot in root and the log files that
    came after it; only those are read.  A later entry without a time does not replace one with a time."""
    snapshot = versions.read(spark, root)
    _, new = _tail(spark, log, snapshot)
    tail = _entries(spark, log, new).select("path", "user_decision", "timestamp")
    return _latest(tail if snapshot is None else tail.unionByName(snapshot.where("kind = 'label'").select("path", "user_decision", "timestamp")))


def compact(spark: SparkSession, log: str, root: str) -> int:
    """Makes a new snapshot of the log and returns its version; the log itself stays, as training reads it whole.

    Of two compactions at once one fails with Conflict and changes nothing; entries appended meanwhile are in the tail.
    """
    after = max(versions.versions(spark, root), default=0)
    snapshot = versions.read(spark, root, after) if after else None
    covered, new = _tail(spark, log, snapshot)
    tail = _entries(spark, log, new).select("path", "user_decision", "timestamp")
    labels = _latest(tail if snapshot is None else tail.unionByName(snapshot.where("kind = 'label'").select("path", "user_decision", "timestamp")))
    files = spark.createDataFrame([(n,) for n in covered + new], "path string")
    rows = labels.select(F.lit("label").alias("kind"), "path", "user_decision", "timestamp").unionByName(
        files.select(F.lit("file").alias("kind"), "path", F.lit(None).cast("string").alias("user_decision"), F.lit(None).cast("timestamp").alias("timestamp"))
    )
    return versions.commit(rows, root, after)
