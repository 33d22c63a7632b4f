"""The whole run over a folder of photographs, as one lazy plan with tables between stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as c
from ..config import RunConfig, preset
from ..functions import metrics as m
from ..functions import regions
from ..functions.prompts import explain_prompt, scoring_prompt
from ..functions.text import explain_hints, prompt_hints
from ..operators import answers, decide, feedback, frames, fusion, pixels, report, sequence, shoot, similarity
from ..operators.select import curate
from ..sources import files, images
from ..tables import scratch

#: What models would say; each table has path and the columns named, and any may be missing.
PROVIDERS = {
    "embeddings": ("embedding",), "scores": ("topiq", "laion", "clipiqa", "composition", "taste", "taste_labels", "subject"),
    "portraits": ("has_portrait", "eye_left", "eye_right", "eyes_closed", "occluded", "has_face", "shapes"), "geometry": ("tilt", "keystone"),
    "capture": ("iso", "shutter", "aperture", "focal_length_mm", "palette_l", "palette_a", "palette_b"), "sharpness": ("subject_sharpness", "background_sharpness"),
    "regions": ("face", "salient"),
}


def shoot_of(path: Column, config: RunConfig) -> Column:
    """The shoot a photograph belongs to: the whole run, or its folder."""
    return F.regexp_replace(path, "/[^/]*$", "") if config.is_shoot_a_folder else F.lit("")


def add_missing(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.withColumns({k: F.lit(None).cast(v) for k, v in kinds.items() if k not in df.columns})


@dataclass
class Run:
    decisions: DataFrame
    selection: DataFrame | None
    summary: DataFrame
    #: One row with shares, times and advice.
    card: DataFrame | None = None
    #: (path, explanation, weaknesses, strengths, confidence, is_parse_error) of what was rejected, if a model was asked.
    explanations: DataFrame | None = None


def subject_sharpness(images_: DataFrame, regions_: DataFrame) -> DataFrame:
    """(path, subject): sharpness of the face, else of what is salient, else of the frame.  regions_: (path, face, salient), a
    box in pixels and one in shares of the frame; either may be null or missing."""
    known = add_missing(regions_, {"face": "struct<x0:int,y0:int,x1:int,y1:int>", "salient": "struct<x0:double,y0:double,x1:double,y1:double>"})
    sized = images_.join(known.select("path", "face", "salient"), "path", "left")
    region = regions.subject_region(F.col("face").isNotNull(), F.col("face"), F.col("salient"), F.col("image.width"), F.col("image.height"))
    wanted = sized.withColumn("wanted", F.array(F.struct(F.lit("subject").alias("name"), region["box"].alias("box"))))
    return pixels.region_sharpness(wanted, "path", "wanted").select(F.col("id").alias("path"), F.col("tenengrad").alias("subject"))


def by_profile(alive: DataFrame, profile: str) -> DataFrame:
    """alive with taste and taste_labels by the profile kept in a folder, from the scores that overrides log, sorted by name;
    neutral if there is no profile or it has seen few labels."""
    found = feedback.load_profile(alive.sparkSession, profile)
    keys = sorted(files.SCORE_KEYS)
    own = alive.withColumn("_features", F.array(*[F.coalesce(F.col(k).cast("double"), F.lit(0.0)) if k in alive.columns else F.lit(0.0) for k in keys]))
    own = feedback.score(own.drop("taste", "taste_labels"), "_features", found[0] if found else None, found[1] if found else 0)
    return own.drop("_features", "taste_weight", "taste_source")


def run(
    spark: SparkSession, root: str, config: RunConfig, providers: dict[str, DataFrame], generate: Callable[[str], str] | None = None,
    profile: str | None = None, explain: Callable[[str], str] | None = None, cache: tuple[str, str, Callable[[DataFrame], DataFrame]] | None = None,
) -> Run:
    """Stage 1 always runs; stage 2 needs scores; stage 3 needs stage 2 and generate, and sees AMBIGUOUS rows only.

    What no provider gives is measured where it can be: tilt and keystone from straight lines, a subject's sharpness from its
    region (provider regions).  profile: a folder with a taste profile, for assets without a taste.  explain: a
    model that says why rejected photographs were.  cache: (folder, model id, embed) of embeddings, of which only
    those of changed files are made anew.
    """
    scan = scratch(images.scan(spark, root), "scan")
    shots = scan.join(images.exif(spark, root), "path", "left").withColumn("taken_at", images.capture_time(F.col("taken"), F.col("modified")))

    def add(df: DataFrame, name: str) -> DataFrame:
        table = providers.get(name)
        if table is None:
            return df
        return df.join(table.select("path", *[k for k in PROVIDERS[name] if k in table.columns and k not in df.columns]), "path", "left")

    second = 2 in config.stages and "scores" in providers
    own_lines = second and "geometry" not in providers and not config.is_fast
    if cache is not None and "embeddings" not in providers:
        providers = providers | {"embeddings": files.refresh_embeddings(scan.select("path", "modified"), *cache)}
    measured = pixels.image_metrics(images.decode(spark, root), "path", lines=own_lines).withColumnRenamed("id", "path")
    if "sharpness" in providers:
        measured = add(measured.drop(*PROVIDERS["sharpness"]), "sharpness")
    first = scratch(pixels.first_stage(measured), "stage1")

    empty = scan.select("path").limit(0)
    duplicates = empty
    if "embeddings" in providers:
        pairs = similarity.near_pairs(providers["embeddings"], "path", "embedding", config.near_cosine)
        duplicates = similarity.duplicate_groups(pairs).where("not is_source").select(F.col("id").alias("path"))
    timed = shots.select("path", "taken_at").join(first.where("passed").select("path", "dhash", "tenengrad"), "path").withColumn("shoot", shoot_of(F.col("path"), config))
    grouped = sequence.leader_groups(sequence.bursts(timed, ["shoot"], "taken_at", "path", config.burst_gap), ["shoot"], "taken_at", "path", "dhash")
    ranked = scratch(sequence.rank_bursts(grouped.withColumn("burst", F.concat_ws("/", F.col("burst").cast("string"), F.col("subgroup").cast("string"))), ["shoot"], "taken_at", "path", "tenengrad"), "bursts")
    losers = ranked.where("not is_burst_winner").select("path")

    s2 = spark.createDataFrame([], "path string, routing string, composite double")
    s3 = spark.createDataFrame([], "path string, kept boolean, confidence double")
    if second:
        alive = decide.survivors(first.where("passed").select("path", F.col("range_score").alias("exposure"), "is_bokeh"), losers, duplicates, "path")
        alive = alive.join(shots.select("path", "taken_at"), "path")
        for name in ("scores", "portraits", "geometry", "capture"):
            alive = add(alive, name)
        if own_lines:
            alive = alive.join(pixels.geometry(frames.segments(first, "path"), "path").select("path", "tilt", "keystone"), "path", "left")
        if "regions" in providers and "subject" not in alive.columns:
            alive = alive.join(subject_sharpness(images.decode(spark, root).join(alive.select("path"), "path", "left_semi"), providers["regions"]), "path", "left")
        if profile is not None and "taste" not in alive.columns:
            logged = first.select("path", *[F.col(k).alias(v) for k, v in files.SCORE_KEYS_OF.items()])
            alive = by_profile(alive.join(logged, "path", "left"), profile).drop(*[k for k in files.SCORE_KEYS_OF.values() if k not in alive.columns])
        if {"tilt", "keystone"} <= set(alive.columns):
            alive = alive.withColumn("tilt_penalty", m.tilt_penalty(F.col("tilt"), F.col("keystone")))
        if config.is_fast:
            fused = fusion.fuse_fast(alive, config.preset)
        else:
            once = fusion.fuse(alive.withColumn("exposure", F.coalesce("exposure", F.lit(1.0))).withColumn("topiq_raw", F.col("topiq")), config.preset).withColumn("shoot", shoot_of(F.col("path"), config))
            keys = [k for k in ("iso", "shutter", "aperture", "focal_length_mm") if k in once.columns]
            stats = sequence.scenes(scratch(once, "fused"), ["shoot"], "taken_at", "path")
            lab = [k if k in stats.columns else None for k in ("palette_l", "palette_a", "palette_b")]
            stats = stats.withColumns({f"_l{i}": F.col(k) if k else F.lit(0.0) for i, k in enumerate(lab)})
            stats = shoot.outliers(stats, ["shoot"], ("_l0", "_l1", "_l2"), "exposure")
            if keys:
                stats = shoot.anomalies(shoot.first_position(stats, ["shoot"], ["path"]), ["shoot"], keys, "pos")
            fused = fusion.refuse(stats, config.preset, config.refuse_mode)
        fused = scratch(fused, "stage2")
        s2 = fused.select("path", "routing", "composite")
        if 3 in config.stages and generate is not None:
            open_ = add_missing(fused.where("routing = 'AMBIGUOUS'").join(first.select("path", "motion_ratio", "exposure_flags"), "path"), {"composition": "double", "emotion": "string", "has_face": "boolean", "eyes_closed": "boolean", "occluded": "boolean", "is_bokeh": "boolean"})
            flag = lambda k: F.col(f"exposure_flags.{k}")
            hints = prompt_hints(F.col("composite"), F.col("composition"), F.col("motion_ratio") > c.MOTION_RATIO, F.col("is_bokeh"), F.col("has_face"), F.col("emotion"), F.col("eyes_closed"), F.col("occluded"), flag("highlight_clip"), flag("shadow_clip"), flag("color_cast"))
            asked = answers.ask(open_.select("path", scoring_prompt(config.preset, hints).alias("prompt")), "prompt", generate)
            s3 = scratch(answers.scored(asked).select("path", F.col("stage3.is_keeper").alias("kept"), F.col("stage3.confidence").alias("confidence")), "stage3")

    decisions = scratch(decide.assemble(scan, first.select("path", "passed", "reject_reason", "exposure_flags"), s2, s3, losers, duplicates, "path").join(ranked.select("path", "burst", "burst_rank", "burst_size", "is_burst_winner"), "path", "left"), "decisions")
    selection = None
    if config.curate_target is not None:
        keepers = decisions.where("decision = 'keeper'").select("path", "composite")
        for name in ("embeddings", "portraits"):
            keepers = add(keepers, name)
        missing = {"embedding": "array<float>", "has_face": "boolean", "is_motion": "boolean", "shapes": "map<string,double>", "motion": "double"}
        keepers = add_missing(keepers, missing)
        selection = scratch(curate(keepers, "path", "composite", "embedding", config.curate_target, preset(config.preset)["cluster"]), "selection")
        decisions = decide.mark_selected(decisions, selection, "path")
        decisions = scratch(decisions, "decisions")
    facts = add_missing(add(decisions.select("path", "decision", "reject_reason", "burst", "passed", "exposure_flags", "kept").join(shots.select("path", "taken_at", "exposure_n", "exposure_d"), "path", "left"), "portraits"), {"eye_left": "double", "eye_right": "double", "eyes_closed": "boolean"})
    flag = lambda k: F.coalesce(F.col(f"exposure_flags.{k}"), F.lit(False))
    why = report.reject_reason(F.col("decision"), F.col("reject_reason"), F.col("burst"), F.col("passed"), flag("highlight_clip") | flag("shadow_clip"), F.col("kept"))
    facts = facts.withColumn("_seconds", F.try_divide(F.col("exposure_n"), F.col("exposure_d")))
    card = report.report_card(facts, why, F.col("taken_at"), "_seconds", "eye_left", "eye_right", "eyes_closed")
    explanations = None
    if explain is not None:
        asked = decisions.where("decision = 'rejected'").select("path", "decision", "composite").join(first.select("path", "motion_ratio", "is_bokeh", "exposure_flags", "noise"), "path")
        hints = explain_hints(F.col("motion_ratio") > c.MOTION_RATIO, F.col("is_bokeh"), flag("highlight_clip"), flag("shadow_clip"), flag("color_cast"), F.col("noise"), F.col("composite"))
        said = answers.explained(answers.ask(asked.select("path", explain_prompt(F.col("decision"), hints).alias("prompt")), "prompt", explain))
        explanations = scratch(said.select("path", "explained.*"), "explained")
    return Run(decisions, selection, report.summary(decisions), card, explanations)


def deliver(decisions: DataFrame, root: str, existing: DataFrame | None = None, sidecars: bool = False, geometry: DataFrame | None = None, dry_run: bool = True) -> DataFrame:
    """Moves what a run decided: one row with total, moved, skipped, errors and sidecars.

    With sidecars, keepers and selects first get an XMP document beside where they are now (with tilt and keystone of geometry:
    path, tilt, keystone), and files then take it along.  existing: (path, current) of files moved before.  In a dry
    run nothing is written.
    """
    spark = decisions.sparkSession
    named = decisions.select("path", "decision", F.lit(root).alias("root"), F.element_at(F.split("path", "/"), -1).alias("name"))
    moved = existing if existing is not None else spark.createDataFrame([], "path string, current string")
    plan = scratch(decide.move_plan(named, moved, "path"), "plan")
    written = 0
    if sidecars:
        lines = add_missing(geometry if geometry is not None else named.select("path").limit(0), {"tilt": "double", "keystone": "double"})
        wanted = plan.select("path", "decision", F.col("source").alias("at")).join(lines.select("path", "tilt", "keystone"), "path", "left")
        none = F.lit(None).cast("struct<top:int,left:int,bottom:int,right:int>")
        documents = files.sidecars(wanted, F.col("tilt"), F.col("keystone"), none, "at")
        written = documents.count() if dry_run else files.write_sidecars(documents)
    return files.apply_moves(plan, dry_run).withColumn("sidecars", F.lit(written).cast("bigint"))
