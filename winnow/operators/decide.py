"""Assembly of decisions, overrides and destinations: equi-joins on the asset's id and CASE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as c
from .ranking import ranked

REVIEW = {"rejected": "_review/_rejected", "duplicate": "_review/_duplicates", "uncertain": "_review/_uncertain"}


def survivors(assets: DataFrame, losers: DataFrame, duplicates: DataFrame, id_col: str) -> DataFrame:
    """Assets that neither lost a burst nor are duplicates."""
    return assets.join(losers, id_col, "left_anti").join(duplicates, id_col, "left_anti")


def decision(duplicate: Column, loser: Column, passed: Column, routing: Column, kept: Column) -> Column:
    """The first that holds: duplicate, burst loser, not passed, no second stage, route, second opinion, uncertain."""
    return (
        F.when(duplicate, "duplicate").when(loser, "rejected").when(passed == F.lit(False), "rejected").when(routing.isNull(), "uncertain")
        .when(routing == "KEEPER", "keeper").when(routing == "REJECT", "rejected").when(kept, "keeper").when(kept == F.lit(False), "rejected").otherwise("uncertain")
    )


def assemble(scan: DataFrame, s1: DataFrame, s2: DataFrame, s3: DataFrame, losers: DataFrame, duplicates: DataFrame, id_col: str) -> DataFrame:
    """One row per scanned asset: s1 (passed, reject_reason), s2 (routing, composite), s3 (kept, confidence) by id."""
    mark = lambda df, name: df.select(id_col).distinct().withColumn(name, F.lit(True))
    out = scan.join(s1, id_col, "left").join(s2, id_col, "left").join(s3.withColumn("_s3", F.lit(True)), id_col, "left")
    out = out.join(mark(losers, "is_loser"), id_col, "left").join(mark(duplicates, "is_duplicate"), id_col, "left").fillna(False, ["is_loser", "is_duplicate"])
    reached = F.when(F.col("_s3"), 3).when(F.col("routing").isNotNull(), 2).otherwise(1)
    label = decision(F.col("is_duplicate"), F.col("is_loser"), F.col("passed"), F.col("routing"), F.col("kept"))
    return out.withColumn("decision", label).withColumn("stage_reached", reached).drop("_s3")


def mark_selected(decisions: DataFrame, selection: DataFrame, id_col: str) -> DataFrame:
    chosen = selection.select(id_col).distinct().withColumn("_chosen", F.lit(True))
    return decisions.join(chosen, id_col, "left").withColumn("decision", F.when(F.col("_chosen"), "select").otherwise(F.col("decision"))).drop("_chosen")


def destination(label: Column, root: Column, name: Column) -> Column:
    """Where a file goes: selects and review folders under the root; keepers stay."""
    folder = F.when(label == "select", "_curated/_selects")
    for k, v in REVIEW.items():
        folder = folder.when(label == k, v)
    return F.when(folder.isNull(), F.concat_ws("/", root, name)).otherwise(F.concat_ws("/", root, folder, name))


def move_plan(decisions: DataFrame, existing: DataFrame, id_col: str) -> DataFrame:
    """id, source, destination, action for each asset.  existing: (id, current) of files moved before.

    The source is where the file is now; a file already in place is skipped; keepers are not moved.
    """
    goal = destination(F.col("decision"), F.col("root"), F.col("name"))
    joined = decisions.join(existing.select(id_col, "current"), id_col, "left").withColumn("destination", goal)
    source = F.coalesce("current", F.concat_ws("/", "root", "name"))
    action = F.when(F.col("decision") == "keeper", "stay").when(source == F.col("destination"), "skip").otherwise("move")
    return joined.select(id_col, "decision", source.alias("source"), "destination", action.alias("action"))


def rating(label: Column) -> Column:
    out = F.lit(3)
    for k, v in c.RATINGS.items():
        out = F.when(label == k, v).otherwise(out)
    return out


def override(decisions: DataFrame, overrides: DataFrame, id_col: str, by: str = "user_tui") -> DataFrame:
    """Decisions with the latest override of each id (overrides: id, label, seq) taking their place."""
    latest = overrides.groupBy(id_col).agg(F.max(F.struct("seq", "label"))["label"].alias("_label"))
    joined = decisions.join(latest, id_col, "left")
    done = F.col("_label").isNotNull()
    return joined.withColumns({
        "override_from": F.when(done, F.col("decision")), "override_by": F.when(done, F.lit(by)),
        "is_override": done, "decision": F.coalesce("_label", "decision"),
    }).drop("_label")


def undo(overrides: DataFrame, id_col: str, order: str = "seq") -> DataFrame:
    """Overrides with each id's last one taken back."""
    last = overrides.groupBy(id_col).agg(F.max(order).alias("_last"))
    return overrides.join(last, id_col).where(F.col(order) < F.col("_last")).drop("_last")


def restore(decisions: DataFrame, overrides: DataFrame, id_col: str, order: str = "seq") -> DataFrame:
    """The entries (id, label, order) that undo each id's last override: the label it had before, from the override before or
    else the decision, as an override of its own after the last one."""
    last = Window.partitionBy(id_col).orderBy(F.col(order).desc())
    # lead in descending order is the override before; an id has as many as its user made
    ranked_ = overrides.select(id_col, "label", order).withColumn("_r", F.row_number().over(last)).withColumn("_before", F.lead("label").over(last)).where("_r = 1")
    newest = overrides.agg(F.max(order)).first()[0]  # one number
    joined = ranked_.join(decisions.select(id_col, "decision"), id_col)
    return joined.select(id_col, F.coalesce("_before", "decision").alias("label"), (F.lit(newest) + 1).cast(overrides.schema[order].dataType).alias(order))


def override_group(decisions: DataFrame, group: str, chosen: DataFrame, id_col: str, label: str) -> DataFrame:
    """Overrides for all rows that share the group of a chosen row; without a group, for the chosen row itself."""
    hit = decisions.join(chosen.select(id_col).distinct(), id_col, "left_semi")
    groups = hit.where(F.col(group).isNotNull()).select(group).distinct()
    ids = decisions.join(groups, group, "left_semi").select(id_col).union(hit.where(F.col(group).isNull()).select(id_col))
    return ids.distinct().withColumn("label", F.lit(label))


def auto_accept(decisions: DataFrame) -> DataFrame:
    """Uncertain rows with a confident second opinion become keeper or rejected."""
    sure = (F.col("decision") == "uncertain") & (F.col("confidence") > c.AUTO_ACCEPT)
    return decisions.withColumn("decision", F.when(sure, F.when(F.col("kept"), "keeper").otherwise("rejected")).otherwise(F.col("decision")))


def _review_order(taste: str, pos: str) -> list[Column]:
    return [F.coalesce(F.abs(F.col(taste) - 0.5), F.lit(-1.0)).desc(), F.col(pos).asc()]


def review_queue(df: DataFrame, taste: str, pos: str) -> DataFrame:
    """df in review order: by |taste - 0.5| descending, rows without taste after, if any row has taste; else by pos."""
    return df.orderBy(*_review_order(taste, pos))


def review_places(df: DataFrame, taste: str, pos: str) -> DataFrame:
    """df with place, from 1, in review order."""
    return ranked(df, _review_order(taste, pos), "place").withColumn("place", F.col("place") + 1)


def latest(df: DataFrame, order: str, k: int = c.LOG_TAIL, id_col: str = "id") -> DataFrame:
    return df.orderBy(F.col(order).desc(), F.col(id_col)).limit(k)


def sample(df: DataFrame, by: str, id_col: str, k: int = c.EXIF_SAMPLE, seed: int = 7) -> DataFrame:
    """k rows of each class, by hash: the same rows every time."""
    order = Window.partitionBy(by).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
