"""Tables that are swapped whole: each version is a folder that appears by one rename, so readers see all of it or none.

Folders are root/v000000000001 and so on.  A writer works in root/_writing-...; one that dies leaves that folder, which
no reader looks at, and the version before as it was.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..tables import drop_folder


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, in order; none if it does not exist.  Any other failure is raised."""
    path, fs = _files(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    return [int(n[1:]) for n in names(spark, root) if n[0] == "v" and n[1:].isdigit()]


def folder(root: str, version: int) -> str:
    return f"{root}/v{version:012d}"


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """A version of a table, the latest by default; None if there is none yet."""
    if version is None:
        version = max(versions(spark, root), default=None)
        if version is None:
            return None
    return spark.read.parquet(folder(root, version))


def commit(df: DataFrame, root: str, after: int | None = None, keep: int = 2) -> int:
    """Writes df as the next version and returns its number; then only the last `keep` versions stay.

    after: the version that df was made from (0: none yet); if another has come since, Conflict is raised and nothing
    changes.  Of two writers at once one wins.
    """
    spark = df.sparkSession
    writing = f"{root}/_writing-{uuid.uuid4().hex}"
    df.write.parquet(writing)
    last = max(versions(spark, root), default=0)
    try:
        if after is not None and after != last:
            raise Conflict(f"version {last} of {root} came after {after}")
        jvm = spark._jvm
        source, target = (jvm.org.apache.hadoop.fs.Path(x) for x in (writing, folder(root, last + 1)))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
        how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # fails if the target exists
        try:
            context.rename(source, target, how)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {last + 1} of {root} is there already") from e
            raise
    except BaseException:
        drop_folder(spark, writing)
        raise
    for old in versions(spark, root)[:-keep]:
        drop_folder(spark, folder(root, old))
    return last + 1


def clean(spark: SparkSession, root: str, older_seconds: float = 86_400) -> int:
    """Removes what writers that died have left and nobody has touched for that long; returns how many folders."""
    path, fs = _files(spark, root)
    now = spark._jvm.java.lang.System.currentTimeMillis()
    gone = [s.getPath().toString() for s in (fs.listStatus(path) if fs.exists(path) else []) if s.getPath().getName().startswith("_writing-") and now - s.getModificationTime() >= older_seconds * 1000]
    for x in gone:
        drop_folder(spark, x)
    return len(gone)
