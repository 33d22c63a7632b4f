"""Tables that plans pause at: written to the folder all executors share, and read again."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
_made: ContextVar[list | None] = ContextVar("made", default=None)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset and Spark runs in one process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    made = sc._jsc.sc().getCheckpointDir()
    if not made.isDefined():
        if not named:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="winnow-")
        sc.setCheckpointDir(named)
        made = sc._jsc.sc().getCheckpointDir()
    return (named or str(made.get())).rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: the plan starts anew from files
    that every executor sees, so a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/winnow-{name}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append((spark, path))  # before it is written: a write that fails leaves files too
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(df: DataFrame) -> None:
    """Removes the files of a table made by scratch(), once nothing reads it any more."""
    spark = df.sparkSession
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        if os.path.basename(f).startswith("winnow-"):
            drop_folder(spark, f)


@contextmanager
def tables_removed() -> Iterator[None]:
    """Removes the tables that scratch() wrote within, at the end, whether or not an error ends it.

    A query's result reads such tables, so write or collect it within.  Of nested ones each removes its own.
    """
    made: list[tuple[SparkSession, str]] = []
    before = _made.set(made)
    try:
        yield
    finally:
        _made.reset(before)
        for spark, path in made:
            drop_folder(spark, path)
