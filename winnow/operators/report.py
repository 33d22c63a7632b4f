"""Session summaries: conditional aggregates over the decisions table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as c
from .medians import medians

LABELS = ("keeper", "rejected", "duplicate", "uncertain", "select")
REASONS = ("blur", "exposure", "noise", "burst", "duplicate", "vlm")


def _is(label: str, names: tuple[str, ...]) -> Column:
    return F.col(label).isin(*names)


def summary(decisions: DataFrame, label: str = "decision") -> DataFrame:
    """One row: total and a count for each label."""
    return decisions.agg(F.count("*").alias("total"), *[F.count_if(F.col(label) == x).alias(x) for x in LABELS])


def keep_rate(decisions: DataFrame, label: str = "decision") -> DataFrame:
    counts = decisions.agg(F.count_if(_is(label, c.KEEP_LABELS)).alias("kept"), F.count_if(_is(label, c.REJECT_LABELS)).alias("rejected"))
    return counts.withColumn("keep_rate", F.when(F.col("kept") + F.col("rejected") == 0, F.lit(0.0)).otherwise(F.col("kept") / (F.col("kept") + F.col("rejected"))))


def reject_reason(label: Column, reason: Column, burst: Column, passed: Column, bad_exposure: Column, kept: Column) -> Column:
    """The first that fits; blur if none does."""
    return (
        F.when(label == "duplicate", "duplicate").when(reason == "blur", "blur").when(reason == "noise", "noise").when(burst.isNotNull(), "burst")
        .when((passed == F.lit(False)) & bad_exposure, "exposure").when(kept == F.lit(False), "vlm").otherwise("blur")
    )


def reject_breakdown(decisions: DataFrame, reason: Column, label: str = "decision") -> DataFrame:
    """One row: the share of each reason among rejects; zeros if there are none."""
    rejects = decisions.where(_is(label, c.REJECT_LABELS)).select(reason.alias("why"))
    total = F.count("*")
    return rejects.agg(*[F.when(total == 0, F.lit(0.0)).otherwise(F.count_if(F.col("why") == x) / total).alias(f"{x}_share") for x in REASONS])


def modal(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest non-empty value for each key; the smallest wins a tie."""
    counts = df.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*keys, value).agg(F.count("*").alias("n"))
    most = counts.groupBy(*keys).agg(F.max("n").alias("n"))
    return counts.join(most, [*keys, "n"]).groupBy(*keys).agg(F.min(value).alias(value))


def motion_risk(samples: DataFrame, seconds: str) -> DataFrame:
    """One row: the share of samples slower than 1/125 s; unreadable ones count as not slow."""
    slow = F.count_if(F.coalesce(F.col(seconds) > c.MOTION_RISK_SECONDS, F.lit(False)))
    return samples.agg(F.count("*").alias("samples"), F.when(F.count("*") == 0, F.lit(0.0)).otherwise(slow / F.count("*")).alias("motion_risk"))


def portrait_stats(decisions: DataFrame, left: str, right: str, closed: str, label: str = "decision") -> DataFrame:
    """One row over keepers: subjects, median eye sharpness, share of closed eyes; all null without any sharpness."""
    n = F.col(left).isNotNull().cast("int") + F.col(right).isNotNull().cast("int")
    own = (F.coalesce(F.col(left), F.lit(0.0)) + F.coalesce(F.col(right), F.lit(0.0))) / F.nullif(n, F.lit(0))
    keepers = decisions.where(_is(label, c.KEEP_LABELS)).select(own.alias("sharp"), F.coalesce(F.col(closed), F.lit(False)).alias("closed"))
    some = F.count("sharp") > 0
    counts = keepers.agg(F.when(some, F.count("*")).alias("unique_subjects"), F.when(some, F.count_if("closed") / F.count("*")).alias("eyes_closed_rate"))
    middle = medians(keepers, [], {"eye_sharpness_median": F.col("sharp")}).withColumn("_1", F.lit(1))
    return counts.withColumn("_1", F.lit(1)).join(middle, "_1").select("unique_subjects", "eye_sharpness_median", "eyes_closed_rate")


def timing(decisions: DataFrame, taken: Column) -> DataFrame:
    """One row: first and last capture, seconds between, photos per minute (of all decisions)."""
    rows = decisions.select(taken.cast("timestamp").alias("t"))
    out = rows.agg(F.min("t").alias("first_capture"), F.max("t").alias("last_capture"), F.count("*").alias("photos"))
    span = F.coalesce((F.unix_micros("last_capture") - F.unix_micros("first_capture")) / 1e6, F.lit(0.0))
    return out.withColumn("duration_seconds", span).withColumn("photos_per_minute", F.when(F.col("duration_seconds") > 0, F.col("photos") / F.col("duration_seconds") * 60).otherwise(0.0))


def advice(motion: Column, exposure: Column, rate: Column) -> Column:
    """An array of sentences."""
    percent = lambda x: F.concat(F.bround(x * 100, 0).cast("int").cast("string"), F.lit("%"))
    # Fixed texts of the report.
    said = F.filter(F.array(
        F.when(motion > c.MOTION_ADVICE, F.concat(F.lit("Consider raising minimum shutter speed to 1/125s or faster — "), percent(motion), F.lit(" of rejects were below it."))),
        F.when(exposure > c.EXPOSURE_ADVICE, F.concat(F.lit("Exposure issues drove "), percent(exposure), F.lit(" of rejects — consider EVF review or auto-bracketing."))),
        F.when(rate < c.LOW_KEEP_RATE, F.lit("Keep rate is unusually low — verify your culling thresholds match this preset.")),
    ), lambda x: x.isNotNull())
    return F.when(F.size(said) == 0, F.array(F.lit("No actionable patterns detected this session."))).otherwise(said)


def report_card(decisions: DataFrame, reason: Column, taken: Column, seconds: str, left: str, right: str, closed: str, label: str = "decision") -> DataFrame:
    """One row with all of the above; joins of one-row tables."""
    parts = [
        keep_rate(decisions, label), reject_breakdown(decisions, reason, label), motion_risk(decisions.where(_is(label, c.REJECT_LABELS)), seconds),
        portrait_stats(decisions, left, right, closed, label), timing(decisions, taken),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.withColumn("_1", F.lit(1)).join(p.withColumn("_1", F.lit(1)), "_1").drop("_1")
    return out.withColumn("advice", advice(F.col("motion_risk"), F.col("exposure_share"), F.col("keep_rate")))


def stage1_tallies(rows: DataFrame) -> DataFrame:
    """Counts over is_bokeh, passed, has_clip, has_cast, is_duplicate: bokeh before sharp, clip before cast."""
    bokeh, sharp = F.col("is_bokeh"), ~F.col("is_bokeh") & F.col("passed")
    return rows.agg(
        F.count_if(bokeh).alias("bokeh"), F.count_if(sharp).alias("sharp"), F.count_if(~bokeh & ~F.col("passed")).alias("soft"),
        F.count_if("has_clip").alias("clip"), F.count_if(~F.col("has_clip") & F.col("has_cast")).alias("cast"), F.count_if(~F.col("has_clip") & ~F.col("has_cast")).alias("good"),
        (F.count_if(bokeh) + F.count_if(sharp) - F.count_if("is_duplicate")).alias("passed"),
    )


def stage2_tallies(rows: DataFrame) -> DataFrame:
    """Counts per route, and of rows whose shoot statistics reach one half."""
    half = lambda k: F.count_if(F.coalesce(F.col(k), F.lit(0.0)) >= 0.5)
    return rows.agg(*[F.count_if(F.col("routing") == x).alias(x.lower()) for x in ("KEEPER", "AMBIGUOUS", "REJECT")], half("palette_outlier").alias("palette"), half("exposure_drift").alias("drift"), half("exif_anomaly").alias("exif"), half("scene_bonus").alias("scene"))


def sparkline(df: DataFrame, score: str, order: str, width: int = 40, rows_per_cell: int = 100_000) -> DataFrame:
    """(bin, mean): scores in order, in bins of max(n // width, 1) rows, the first `width` bins.

    Positions come from ranks within ranges of the order column, so no task ranks everything.
    """
    n = df.count()
    size, cells = max(n // width, 1), max(1, n // rows_per_cell)
    placed = df.select(F.col(score).alias("s"), F.col(order).alias("o"))
    bounds = placed.approxQuantile("o", [k / cells for k in range(1, cells)], 0.001) if cells > 1 else []
    placed = placed.withColumn("cell", sum(((F.col("o") > b).cast("int") for b in bounds), F.lit(0)))
    before = placed.groupBy("cell").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    ranked = placed.join(F.broadcast(before), "cell").withColumn("pos", F.col("before") + F.row_number().over(Window.partitionBy("cell").orderBy("o")) - 1)
    return ranked.groupBy(F.floor(F.col("pos") / size).alias("bin")).agg(F.avg("s").alias("mean")).where(F.col("bin") < width)


def divergence(current: DataFrame, expected: DataFrame, id_col: str, value: str, category: str, tolerance: float) -> DataFrame:
    """(category, diverged, worst): rows that differ by more than tolerance or are on one side only."""
    joined = current.select(id_col, F.col(value).alias("_a"), F.col(category).alias("_ca")).join(expected.select(id_col, F.col(value).alias("_b"), F.col(category).alias("_cb")), id_col, "full_outer")
    gap = F.abs(F.col("_a") - F.col("_b"))
    off = joined.where(gap.isNull() | (gap > tolerance)).withColumn("gap", gap).withColumn(category, F.coalesce("_ca", "_cb"))
    return off.groupBy(category).agg(F.count("*").alias("diverged"), F.max("gap").alias("worst"))


def fingerprint(files: DataFrame, name: str, digest: str) -> DataFrame:
    """One row: a hash over all files that no order of rows changes.

    Files are hashed in 65,536 buckets by the first four digits of their digest, then the buckets' hashes: no task gathers
    all lines.
    """
    lines = files.select(F.substring(digest, 1, 4).alias("bucket"), F.concat(F.col(name), F.lit("\t"), F.col(digest)).alias("line"))
    parts = lines.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("part"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "part"))), lambda x: x["part"]), "\n"), 256).alias("fingerprint"))


def corpus_fingerprint(files: DataFrame, name: str, digest: str) -> DataFrame:
    """One row: sha256 of the sorted "name<tab>digest" lines, as other tools make it.  Gathers all lines in one task;
    fingerprint() is the form for large sets."""
    lines = F.concat(F.col(name), F.lit("\t"), F.col(digest))
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(lines)), "\n"), 256).alias("fingerprint"))


#: Prefixes of synthetic files' names.
SYNTHETIC = ("synth_blur", "synth_dupe", "synth_motion", "synth_noisy", "synth_overexp", "synth_underexp")


def synthetic_kind(name: Column) -> Column:
    """Null for files that are not synthetic; those stay out of burst detection."""
    out = F.lit(None).cast("string")
    for kind in SYNTHETIC:
        out = F.when(F.startswith(name, F.lit(kind + "_")), kind).otherwise(out)
    return out


def manifest_category(name: Column, in_burst: Column) -> Column:
    return F.coalesce(synthetic_kind(name), F.when(in_burst, "burst").otherwise("real"))
