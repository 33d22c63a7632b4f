"""Curation: peak picks, diversity, tournament, narrative variety."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as c
from ..functions import vectors as v
from ..functions.metrics import portrait_moment
from ..tables import scratch, ship
from .ranking import ranked
from .similarity import clusters

#: compare(a, b): whether the row a (a dict) beats the row b.
Comparator = Callable[[dict, dict], bool]


def higher_score(a: dict, b: dict) -> bool:
    return (-a["score"], a["id"]) < (-b["score"], b["id"])


def peak_types(members: DataFrame, cluster: str, has_face: str, is_motion: str) -> DataFrame:
    """(cluster, peak_type): portrait or action if at least half of the members are, else composite."""
    share = members.groupBy(cluster).agg(F.avg(F.coalesce(F.col(has_face), F.lit(False)).cast("int")).alias("f"), F.avg(F.coalesce(F.col(is_motion), F.lit(False)).cast("int")).alias("m"))
    return share.select(cluster, F.when(F.col("f") >= 0.5, "portrait").when(F.col("m") >= 0.5, "action").otherwise("composite").alias("peak_type"))


def cluster_winners(members: DataFrame, cluster: str, id_col: str, score: str, has_face: str, is_motion: str, shapes: str, motion: str) -> DataFrame:
    """(cluster, id, reason): the best member by the cluster's peak type; ties go to the smaller id.

    A cluster of one has no reason.  Where no member has the signal of the type, the score decides
    (reason composite_fallback).
    """
    kinds = peak_types(members, cluster, has_face, is_motion)
    joined = members.join(kinds, cluster)
    all_of = Window.partitionBy(cluster)
    signal = F.when(F.col("peak_type") == "portrait", F.when(F.col(shapes).isNotNull(), portrait_moment(F.col(shapes))["score"])).when(F.col("peak_type") == "action", F.col(motion)).otherwise(F.coalesce(F.col(score), F.lit(0.0)))
    joined = joined.withColumn("_s", signal).withColumn("_n", F.count("*").over(all_of)).withColumn("_k", F.count("_s").over(all_of))
    value = F.when(F.col("_k") > 0, F.coalesce("_s", F.lit(float("-inf")))).otherwise(F.coalesce(F.col(score), F.lit(0.0)))
    order = Window.partitionBy(cluster).orderBy(F.col("_v").desc(), id_col)
    best = joined.withColumn("_v", value).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return best.select(cluster, id_col, F.when(F.col("_n") > 1, F.when(F.col("_k") > 0, F.col("peak_type")).otherwise("composite_fallback")).alias("reason"))


def trim(df: DataFrame, score: str, pos: str, limit: int) -> DataFrame:
    return df.orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), pos).limit(limit)


def mmr(pool: DataFrame, id_col: str, embedding: str, score: str, target: int, weight: float = c.MMR_LAMBDA) -> DataFrame:
    """(id, pick): up to target rows by maximal marginal relevance, picks numbered from 1.

    The pool is what trim() left, at most twice the target; a missing embedding is the zero vector.  First maximum
    wins, in order of score and id.  Arithmetic is float32.
    """
    ship(pool.sparkSession)
    kind = pool.schema[id_col].dataType.simpleString()

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(s=pdf["s"].fillna(0.0)).sort_values(["s", "id"], ascending=[False, True], kind="stable")
        size = max((len(e) for e in pdf["e"] if e is not None), default=1)
        rows = np.stack([np.asarray(e, dtype=np.float32) if e is not None else np.zeros(size, np.float32) for e in pdf["e"]])
        relevance, ids = pdf["s"].to_numpy(dtype=np.float32), pdf["id"].to_numpy()
        chosen, near, open_ = [], np.zeros(len(rows), dtype=np.float32), np.ones(len(rows), dtype=bool)
        while len(chosen) < target and open_.any():
            value = np.where(open_, np.float32(weight) * relevance - np.float32(1 - weight) * near, -np.inf)
            best = int(value.argmax())
            similar = rows @ rows[best]
            near = similar if not chosen else np.maximum(near, similar)
            chosen.append(best)
            open_[best] = False
        return pd.DataFrame({"id": ids[chosen], "pick": np.arange(1, len(chosen) + 1)})

    slim = pool.select(F.col(id_col).alias("id"), F.col(embedding).alias("e"), F.col(score).cast("double").alias("s"), F.lit(0).alias("g"))
    return slim.groupBy("g").applyInPandas(pick, f"id {kind}, pick bigint").withColumnRenamed("id", id_col)


def tournament(entries: DataFrame, id_col: str, score: str, beats: Comparator = higher_score, bits: int = 12) -> DataFrame:
    """(id, place): single elimination over the entries, seeded by score; the champion, then losers round by round.

    Neighbours in the order meet; an odd last entry gets a bye.  Blocks of 2**bits neighbours play their first `bits` rounds
    in a task each, then the blocks' winners go on in the same way, so a bracket of any size is spread over tasks.
    """
    ship(entries.sparkSession)
    kind = entries.schema[id_col].dataType.simpleString()
    slim = entries.select(F.col(id_col).alias("id"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"))
    state = ranked(slim, [F.col("score").desc(), F.col("id").asc()], "pos")
    n, done, lost = state.count(), 0, []

    def rounds(done: int):
        def play(pdf: pd.DataFrame) -> pd.DataFrame:
            rows, out = pdf.sort_values("pos").to_dict("records"), []
            for k in range(bits):
                winners = []
                for a, b in zip(rows[::2], rows[1::2]):
                    win, lose = (a, b) if beats(a, b) else (b, a)
                    out.append({**lose, "pos": a["pos"] // 2, "round": done + k + 1})
                    winners.append({**win, "pos": a["pos"] // 2})
                rows = winners + [{**x, "pos": x["pos"] // 2} for x in rows[len(rows) - len(rows) % 2 :]]
            return pd.DataFrame([*out, *[{**x, "round": 0} for x in rows]])[["id", "score", "pos", "round"]]

        return play

    while n > 1:
        played = state.groupBy(F.floor(F.col("pos") / (1 << bits)).alias("block")).applyInPandas(rounds(done), f"id {kind}, score double, pos bigint, round int")
        played = scratch(played, "played")
        lost.append(played.where("round > 0"))
        state, n, done = played.where("round = 0").drop("round"), -(-n >> bits), done + bits
    out = state.withColumn("round", F.lit(0))
    for x in lost:
        out = out.unionByName(x)
    return ranked(out.select(F.col("id").alias(id_col), "round", "pos"), ["round", "pos"], "place").select(id_col, (F.col("place") + 1).alias("place"))


def match_budget(n: int) -> int:
    return n - 1 if n >= 2 else 0


SHOTS = ("close", "medium", "wide")


def variety(shots: DataFrame, shot: str) -> DataFrame:
    """One row: total, the count of each shot type, and variety in 0..1 (0 of nothing)."""
    counts = shots.agg(F.count(shot).alias("total"), *[F.count_if(F.col(shot) == s).alias(f"n_{s}") for s in SHOTS])
    kinds = sum(F.when(F.col(f"n_{s}") > 0, 1).otherwise(0) for s in SHOTS)
    top = F.greatest(*[F.col(f"n_{s}") for s in SHOTS])
    return counts.withColumn("variety", F.when(F.col("total") == 0, F.lit(0.0)).otherwise((kinds / 3.0 + (1 - top / F.col("total"))) / 2))


def variety_swap(selection: DataFrame, candidates: DataFrame, id_col: str, pos: str, shot: str, least: float = c.VARIETY_MIN) -> DataFrame:
    """The selection (id, pos, shot) after at most one swap for variety, with is_swapped.

    Below `least`, the first missing type of close, medium, wide is looked for among candidates (by pos); the first one
    found takes the place of the last row of the dominant type, if that raises variety.
    """
    now = variety(selection, shot).first()  # one row of counts
    if now.total == 0 or now.variety >= least:
        return selection.withColumn("is_swapped", F.lit(False))
    counts = {s: now[f"n_{s}"] for s in SHOTS}
    missing = next((s for s in SHOTS if not counts[s]), None)
    if missing is None:
        return selection.withColumn("is_swapped", F.lit(False))
    dominant = max(SHOTS, key=lambda s: counts[s])
    after = {**counts, missing: 1, dominant: counts[dominant] - 1}
    raised = (sum(n > 0 for n in after.values()) / 3 + 1 - max(after.values()) / now.total) / 2 > now.variety
    found = candidates.where(F.col(shot) == missing).join(selection, id_col, "left_anti").orderBy(pos, id_col).limit(1)
    goes = selection.where(F.col(shot) == dominant).orderBy(F.col(pos).desc(), F.col(id_col).desc()).limit(1)
    if not raised:
        return selection.withColumn("is_swapped", F.lit(False))
    one = F.lit(1).alias("_1")  # at most one row comes and one goes
    swap = found.select(id_col, shot, one).join(goes.select(F.col(id_col).alias("_goes"), pos, one), "_1")
    new = swap.select(id_col, pos, shot)
    kept = selection.select(id_col, pos, shot).join(swap.select(F.col("_goes").alias(id_col)), id_col, "left_anti")
    return kept.withColumn("is_swapped", F.lit(False)).unionByName(new.withColumn("is_swapped", F.lit(True)))


def curate(keepers: DataFrame, id_col: str, score: str, embedding: str, target: int | None, most: float, has_face: str = "has_face", is_motion: str = "is_motion", shapes: str = "shapes", motion: str = "motion", beats: Comparator = higher_score) -> DataFrame:
    """(id, cluster, cluster_size, reason, place): clusters, a winner each, diversity, tournament.

    No more keepers than the target: all of them, without clusters.  There is no fill: fewer clusters than the target
    give fewer rows.  keepers without an embedding are left out of clustering.
    """
    if target is None:
        raise ValueError("a target is needed")
    keepers = scratch(keepers, "keepers")
    n = keepers.count()
    if n <= target:
        order = Window.orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), id_col)
        return keepers.select(id_col, F.lit(0).cast("bigint").alias("cluster"), F.lit(1).cast("bigint").alias("cluster_size"), F.lit(None).cast("string").alias("reason"), F.row_number().over(order).cast("bigint").alias("place"))
    found = clusters(keepers, id_col, embedding, most).withColumnRenamed("id", id_col)
    members = scratch(keepers.join(found, id_col), "members")
    winners = cluster_winners(members, "cluster", id_col, score, has_face, is_motion, shapes, motion)
    pool = trim(members.join(winners.select(id_col, "reason"), id_col), score, id_col, 2 * target)
    picked = scratch(pool.join(mmr(pool.withColumn("_e", v.unit(F.col(embedding))), id_col, "_e", score, target), id_col), "picked")
    return picked.join(tournament(picked, id_col, score, beats), id_col).select(id_col, F.col("cluster").cast("bigint").alias("cluster"), "cluster_size", "reason", "place")
