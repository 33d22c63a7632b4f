"""Reports, logs, sidecars, manifests and model folders as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as c
from ..functions.text import slug
from ..operators.decide import rating
from ..operators.report import manifest_category
from . import versions

OVERRIDE = "timestamp timestamp, path string, filename string, from_label string, user_decision string, stage1_scores map<string,double>, stage2 string, stage3 string, session_source string, origin string, tilt_degrees double, keystone_degrees double"

#: Scores that the log keeps of a decision, and those that the first stage measures, by the name it gives them.
SCORE_KEYS = ["tenengrad", "fft_ratio", "dr_score", "clipping_highlight", "clipping_shadow", "midtone_pct", "color_cast_score", "noise_score", "tilt_degrees", "keystone_degrees"]
SCORE_KEYS_OF = {"tenengrad": "tenengrad", "fft_ratio": "fft_ratio", "range_score": "dr_score", "clip_high": "clipping_highlight", "clip_low": "clipping_shadow", "midtone": "midtone_pct", "cast": "color_cast_score", "noise": "noise_score"}


def write_report(report: DataFrame, path: str, overwrite: bool = False) -> str:
    """Writes a report as JSON lines; an existing one stays unless asked, and the new one goes beside it."""
    spark = report.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not overwrite and target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        stamp = report.sparkSession.sql("select date_format(current_timestamp(), 'yyyyMMdd_HHmmss_SSS')").first()[0]
        path = f"{path}_{stamp}"
    report.write.mode("overwrite" if overwrite else "errorifexists").json(path)
    return path


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "false").json(path)


def append_overrides(entries: DataFrame, path: str) -> None:
    """Adds entries to the log; each append is files of its own, so writers never meet."""
    entries.write.mode("append").json(path)


def read_overrides(spark: SparkSession, path: str | list[str], schema: str = OVERRIDE) -> DataFrame:
    """The entries of a log, or of files of one; blank and malformed lines are skipped."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    parsed = rows.select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("e"))
    return parsed.where("e is not null and e._bad is null").select("e.*").drop("_bad")


def override_entries(decisions: DataFrame, label: Column, source: str, origin: str) -> DataFrame:
    """Decisions flattened to log entries; scores that are null are left out of the map."""
    keys = SCORE_KEYS
    get = lambda k, kind: F.col(k).cast(kind) if k in decisions.columns else F.lit(None).cast(kind)
    scores = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), get(k, "double").alias("value")) for k in keys]), lambda e: e["value"].isNotNull()))
    return decisions.select(
        F.current_timestamp().alias("timestamp"), "path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("decision").alias("from_label"), label.alias("user_decision"),
        scores.alias("stage1_scores"), get("stage2", "string").alias("stage2"), get("stage3", "string").alias("stage3"), F.lit(source).alias("session_source"), F.lit(origin).alias("origin"),
        get("tilt_degrees", "double").alias("tilt_degrees"), get("keystone_degrees", "double").alias("keystone_degrees"),
    )


def sidecar(label: Column, tilt: Column, keystone: Column, crop: Column) -> Column:
    """The XMP document of one decision.  crop: struct(top, left, bottom, right) or null."""
    attribute = lambda name, x: F.when(x.isNotNull(), F.concat(F.lit(f' crs:{name}="'), x.cast("string"), F.lit('"'))).otherwise("")
    # Namespaces of the format.
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:crs="http://ns.adobe.com/camera-raw-settings/1.0/">\n  <rdf:RDF>\n    <rdf:Description rdf:about=""'),
        attribute("Rating", rating(label)), attribute("StraightenAngle", tilt), attribute("PerspectiveVertical", keystone),
        *[attribute(f"Crop{k.title()}", crop[k]) for k in ("top", "left", "bottom", "right")],
        F.lit("/>\n  </rdf:RDF>\n</x:xmpmeta>\n"),
    )


def sidecar_path(path: Column) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".xmp"))


def write_sidecars(documents: DataFrame, path: str = "path", body: str = "sidecar") -> int:
    """Writes each document beside its file, from the executors; returns how many.  For folders that all executors mount."""

    def write(batches):
        import pandas as pd

        for pdf in batches:
            for at, text in zip(pdf[path], pdf[body]):
                with open(at, "w", encoding="utf-8") as f:
                    f.write(text)
            yield pd.DataFrame({"n": [len(pdf)]})

    return documents.select(path, body).mapInPandas(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def sidecars(decisions: DataFrame, tilt: Column, keystone: Column, crop: Column, path: str = "path", label: str = "decision") -> DataFrame:
    """(path, sidecar) of the decisions that get one: keepers and selects.  path is where the sidecar goes."""
    wanted = decisions.where(F.col(label).isin(*c.KEEP_LABELS))
    return wanted.select(sidecar_path(F.col(path)).alias("path"), sidecar(F.col(label), tilt, keystone, crop).alias("sidecar"))


def apply_moves(plan: DataFrame, dry_run: bool = True) -> DataFrame:
    """One row: total, moved, skipped, errors.  Files are moved by the executors, sidecars with them, unless dry_run.  The plan
    runs once, here; the row holds its counts."""

    def move(batches):
        import os
        import shutil

        import pandas as pd

        for pdf in batches:
            done = []
            for source, goal, action in zip(pdf["source"], pdf["destination"], pdf["action"]):
                if action != "move":
                    done.append("skipped")
                elif dry_run:
                    done.append("moved")
                else:
                    try:
                        os.makedirs(os.path.dirname(goal), exist_ok=True)
                        if os.path.exists(source) or not os.path.exists(goal):  # a task that runs again finds its work done
                            shutil.move(source, goal)
                        beside = os.path.splitext(source)[0] + ".xmp"
                        if os.path.exists(beside):
                            shutil.move(beside, os.path.splitext(goal)[0] + ".xmp")
                        done.append("moved")
                    except OSError:
                        done.append("errors")
            yield pd.DataFrame({"outcome": done})

    outcome = plan.select("source", "destination", "action").mapInPandas(move, "outcome string")
    counts = outcome.agg(F.count("*").alias("total"), *[F.count_if(F.col("outcome") == k).alias(k) for k in ("moved", "skipped", "errors")])
    return plan.sparkSession.createDataFrame([counts.first()], counts.schema)


def manifest(files: DataFrame, bursts: DataFrame) -> DataFrame:
    """(name, sha256, bytes, category) from (path, content) and the paths in bursts.  Contents do not cross the join."""
    slim = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("bigint").alias("bytes"))
    marked = slim.join(bursts.select("path").distinct().withColumn("in_burst", F.lit(True)), "path", "left")
    return marked.select("name", "sha256", "bytes", manifest_category(F.col("name"), F.coalesce("in_burst", F.lit(False))).alias("category"))


def model_registry(folders: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(alias, name, directory) from (directory, config): folders whose config JSON has vision_config.

    aliases maps a part of a name to a fixed alias, first match wins; other folders get a slug of their name, the first
    folder keeping a slug that several have or that is a fixed alias already.
    """
    seeing = folders.where(F.array_contains(F.json_object_keys("config"), "vision_config")).withColumn("name", F.element_at(F.split("directory", "/"), -1))
    fixed = F.lit(None).cast("string")
    for part, alias in reversed(aliases.items()):
        fixed = F.when(F.contains(F.lower("name"), F.lit(part.lower())), alias).otherwise(fixed)
    named = seeing.withColumn("fixed", fixed)
    keep = named.where("fixed is not null").groupBy(F.col("fixed").alias("alias")).agg(F.min("directory").alias("directory"))
    rest = named.join(keep.select("directory"), "directory", "left_anti").groupBy(slug(F.col("name")).alias("alias")).agg(F.min("directory").alias("directory")).join(keep.select("alias"), "alias", "left_anti")
    return keep.unionByName(rest).select("alias", F.element_at(F.split("directory", "/"), -1).alias("name"), "directory")


def write_embeddings(rows: DataFrame, root: str, model_id: str) -> int:
    """Commits (path, embedding, model_id, built_at) as a new version of the cache in root; returns its number.  A writer that
    dies leaves the version before as it was."""
    return versions.commit(rows.select("path", "embedding", F.lit(model_id).alias("model_id"), F.current_timestamp().alias("built_at")), root)


def read_embeddings(spark: SparkSession, root: str) -> DataFrame | None:
    """The cache's latest version; None if there is none."""
    return versions.read(spark, root)


def refresh_embeddings(live: DataFrame, root: str, model_id: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The embeddings (path, embedding) of all live files (path, modified), of which only those that the cache in root has not
    got, or that changed since, go through embed: (path, modified) -> (path, embedding).

    Rows of another model and of files that are gone leave the cache.  The new version appears whole; if nothing changed
    there is none.
    """
    spark = live.sparkSession
    after = max(versions.versions(spark, root), default=0)
    cached = versions.read(spark, root, after).where(F.col("model_id") == model_id) if after else None
    if cached is None:
        kept, stale = None, live
    else:
        known = live.join(cached, "path").where("modified <= built_at and embedding is not null")
        kept = known.select("path", "embedding", "model_id", "built_at")
        stale = live.join(known.select("path"), "path", "left_anti")
        if stale.isEmpty() and versions.read(spark, root, after).count() == kept.count():
            return kept.select("path", "embedding")
    began = spark.sql("select current_timestamp()").first()[0]  # a file that changes while it is embedded is stale again
    new = embed(stale).select("path", "embedding", F.lit(model_id).alias("model_id"), F.lit(began).alias("built_at"))
    number = versions.commit(new if kept is None else kept.unionByName(new), root, after)
    return versions.read(spark, root, number).select("path", "embedding")
