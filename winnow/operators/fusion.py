"""Weighted score fusion and routing: one projection of Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as c
from ..functions.vectors import clamp

#: Optional inputs and what stands for them where the frame has no such column.
OPTIONAL = {
    "composition": "double", "taste": "double", "taste_labels": "int", "tilt_penalty": "double", "subject": "double", "is_bokeh": "boolean",
    "has_portrait": "boolean", "eye_left": "double", "eye_right": "double", "eyes_closed": "boolean", "occluded": "boolean",
    "palette_outlier": "double", "exposure_drift": "double", "exif_anomaly": "double", "scene_bonus": "double",
}


def _of(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(OPTIONAL[name])


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def subject_score(tenengrad: Column) -> Column:
    return clamp(tenengrad / c.SUBJECT_DIVISOR)


def blended_topiq(topiq: Column, subject: Column, is_bokeh: Column, w: dict) -> Column:
    """Sharpness of the subject mixed in; the bokeh bonus counts only where there is a subject."""
    blend = min(1.0, max(0.0, w["blend"]))
    mixed = topiq * (1.0 - blend) + subject_score(subject) * blend + F.when(is_bokeh, w["bokeh"]).otherwise(0.0)
    return F.when(subject.isNull(), topiq).otherwise(clamp(mixed))


def portrait_delta(has: Column, left: Column, right: Column, closed: Column, occluded: Column, w: dict) -> Column:
    eyes = (_zero(left) + _zero(right)) / F.nullif(left.isNotNull().cast("int") + right.isNotNull().cast("int"), F.lit(0))
    delta = _zero(subject_score(eyes) * w["portrait"]) - F.when(closed, w["eyes"]).otherwise(0.0) - F.when(occluded, w["occlusion"]).otherwise(0.0)
    return F.when(has, delta).otherwise(0.0)


def route(score: Column) -> Column:
    return F.when(score >= c.KEEPER_MIN, "KEEPER").when(score >= c.AMBIGUOUS_MIN, "AMBIGUOUS").otherwise("REJECT")


def fuse(df: DataFrame, preset: str = "general") -> DataFrame:
    """df with `composite` and `routing`, and `topiq` replaced by the blended one.

    Needs topiq, laion, clipiqa, exposure; every OPTIONAL column may be missing or null, which leaves its term out.
    """
    w = c.preset(preset)
    topiq = blended_topiq(F.col("topiq"), _of(df, "subject"), F.coalesce(_of(df, "is_bokeh"), F.lit(False)), w)
    taste = F.least(F.coalesce(_of(df, "taste_labels"), F.lit(0)) / c.TASTE_RAMP, F.lit(1.0)) * w["taste"] * _of(df, "taste")
    reducer = _zero(_of(df, "scene_bonus")) * w["scene"] - _zero(_of(df, "palette_outlier")) * w["palette"] - _zero(_of(df, "exposure_drift")) * w["drift"] - _zero(_of(df, "exif_anomaly")) * w["exif"]
    terms = topiq * w["topiq"] + F.col("laion") * w["laion"] + F.col("clipiqa") * w["clipiqa"] + F.col("exposure") * w["exposure"]
    base = F.round(terms + _zero(_of(df, "composition")) * w["composition"] + _zero(taste) - _zero(_of(df, "tilt_penalty")) * w["tilt"] + reducer, 9)
    delta = portrait_delta(F.coalesce(_of(df, "has_portrait"), F.lit(False)), _of(df, "eye_left"), _of(df, "eye_right"), F.coalesce(_of(df, "eyes_closed"), F.lit(False)), F.coalesce(_of(df, "occluded"), F.lit(False)), w)
    return df.withColumns({"topiq": topiq, "composite": F.round(clamp(base + delta), 9)}).withColumn("routing", route(F.col("composite")))


def refuse(fused: DataFrame, preset: str = "general", mode: str = "compat") -> DataFrame:
    """A fused frame with shoot columns (palette_outlier, exposure_drift, exif_anomaly, scene_bonus), fused again.

    compat: exposure is the first composite, tilt and bokeh drop out, and topiq, blended already, is blended again.
    clean: the first inputs and the shoot terms; needs `topiq_raw`.
    """
    if mode == "compat":
        again = fused.withColumns({"exposure": F.col("composite"), "tilt_penalty": F.lit(None).cast("double"), "is_bokeh": F.lit(False), "_topiq": F.col("topiq")})
        return fuse(again.drop("composite", "routing"), preset).drop("topiq").withColumnRenamed("_topiq", "topiq")
    return fuse(fused.withColumn("topiq", F.col("topiq_raw")).drop("composite", "routing"), preset)


def fuse_fast(df: DataFrame, preset: str = "general") -> DataFrame:
    """The reduced fusion: topiq, laion and exposure only; the bokeh bonus needs no subject; missing exposure is 0."""
    w = c.fast_weights(preset)
    raw = F.col("topiq") * w["topiq"] + F.col("laion") * w["laion"] + _zero(F.col("exposure")) * w["exposure"] - _zero(_of(df, "tilt_penalty")) * w["tilt"] + F.when(_of(df, "is_bokeh"), w["bokeh"]).otherwise(0.0)
    return df.withColumn("composite", clamp(F.round(raw, 9))).withColumn("routing", route(F.col("composite")))


def could_matter(df: DataFrame, preset: str = "general") -> Column:
    """Whether a perfect composition would leave REJECT: the crop step is skipped where not."""
    best = fuse(df.withColumn("composition", F.lit(1.0)), preset)
    return best["routing"] != "REJECT"
