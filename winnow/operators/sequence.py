"""Sequences in capture time: bursts, scenes, leader groups.

Windows run within ranges of rows, never over a whole shoot: a range's rows look back over its edge through a table with
one row per range.  So a shoot of any length, and a day of any density, is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as c
from ..tables import scratch, ship


def seconds(ts: Column) -> Column:
    """Seconds of a timestamp with or without zone, as double."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def _running(df: DataFrame, keys: list[str], ts: str, id_col: str, breaks, ranges: int | None) -> DataFrame:
    """df with _sec, _prev (the time before), _new and _run (count of _new up to the row): a prefix scan by key.

    Rows are dealt by ranges of key, time and id, so that a key of any length is spread over tasks.  Each range is scanned on
    its own; what it carries on to the next ranges of a key is one row, its last time and its breaks.
    """
    order = [F.col("_sec").asc_nulls_first(), F.col(id_col)]
    timed = df.withColumn("_sec", seconds(F.col(ts)))
    dealt = timed.repartitionByRange(ranges, *keys, *order) if ranges else timed.repartitionByRange(*keys, *order)
    timed = scratch(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    over = Window.partitionBy(*keys).orderBy("_range")  # one row for each range of a key
    # times rise within a range, nulls first: the last is the largest, null if all are
    edges = timed.groupBy(*keys, "_range").agg(F.max("_sec").alias("_last")).withColumn("_edge", F.lag("_last").over(over)).drop("_last")
    near = _by_range(timed, edges, keys).withColumn("_prev", F.when(F.row_number().over(inside) == 1, F.col("_edge")).otherwise(F.lag("_sec").over(inside)))
    marked = near.withColumn("_new", breaks(F.col("_sec"), F.col("_prev")).cast("bigint"))
    sums = marked.groupBy(*keys, "_range").agg(F.sum("_new").alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return _by_range(marked, before, keys).withColumn("_run", F.col("_before") + F.sum("_new").over(inside)).drop("_range", "_edge", "_before")


def _by_range(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what was carried to their key and range; null keys match."""
    own = carry.select(*[F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)], F.col("_range").alias("_at"), *[c for c in carry.columns if c not in (*keys, "_range")])
    same = F.col("_range") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_of{i}"))
    return rows.join(own, same).drop("_at", *[f"_of{i}" for i in range(len(keys))])


def bursts(df: DataFrame, keys: list[str], ts: str, id_col: str, gap: float = c.BURST_GAP, ranges: int | None = None) -> DataFrame:
    """Rows of df in bursts of two or more, with burst (numbered by time within keys) and burst_size.

    A row joins the one before it at a gap of at most `gap` seconds; a null time never joins.  ranges: how many ranges
    of rows to deal; by default as many as the session shuffles to.
    """
    run = _running(df, keys, ts, id_col, lambda now, before: before.isNull() | now.isNull() | (F.abs(now - before) > gap), ranges)
    sizes = run.groupBy(*keys, "_run").agg(F.count("*").alias("burst_size")).where("burst_size > 1")
    return run.join(sizes, [*keys, "_run"]).select(*df.columns, F.col("_run").alias("burst"), "burst_size")


def rank_bursts(grouped: DataFrame, keys: list[str], ts: str, id_col: str, score: str) -> DataFrame:
    """Each burst's rows ranked by score (missing: 0), time and id; rank 1 wins."""
    order = Window.partitionBy(*keys, "burst").orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), F.col(ts), F.col(id_col))
    ranked = grouped.withColumn("burst_rank", F.row_number().over(order))
    return ranked.withColumn("is_burst_winner", F.col("burst_rank") == 1)


def scenes(df: DataFrame, keys: list[str], ts: str, id_col: str, gap: float = c.SCENE_GAP, ranges: int | None = None) -> DataFrame:
    """df with scene (from 0), is_scene_start and scene_bonus; rows are taken in order of time and id.

    The first row starts a scene without a bonus; a later one does, with bonus 1, after more than gap seconds.
    """
    run = _running(df, keys, ts, id_col, lambda now, before: F.coalesce(now - before > gap, F.lit(False)), ranges)
    first = run.groupBy(*keys).agg(F.min(F.struct(F.coalesce("_sec", F.lit(float("-inf"))).alias("s"), id_col)).alias("_first"))
    run = run.join(first, keys).withColumn("_is_first", F.struct(F.coalesce("_sec", F.lit(float("-inf"))).alias("s"), id_col) == F.col("_first"))
    return run.select(*df.columns, F.col("_run").alias("scene"), ((F.col("_new") == 1) | F.col("_is_first")).alias("is_scene_start"), F.col("_new").cast("double").alias("scene_bonus"))


def subgroups(bits: list[int], most: int) -> list[int]:
    """For each hash in order the number of the first subgroup whose first hash is within `most` bits, or of a new one."""
    leaders: list[int] = []
    out = []
    for own in bits:
        near = next((k for k, x in enumerate(leaders) if (x ^ own).bit_count() <= most), len(leaders))
        if near == len(leaders):
            leaders.append(own)
        out.append(near)
    return out


def leader_groups(grouped: DataFrame, keys: list[str], ts: str, id_col: str, bits: str, most: int = c.HAMMING_MAX) -> DataFrame:
    """Visual confirmation within bursts: a row joins the first subgroup whose first row is within `most` bits.

    Adds subgroup (numbered by time within its burst); rows alone in theirs are dropped.  Greedy by definition, so a
    burst's rows meet in one task; bursts are bounded by the gap rule.  One pass of Arrow batches over rows sorted by
    burst and time does all bursts of a task.
    """
    at = [*keys, "burst"]
    dealt = grouped.repartition(*at).sortWithinPartitions(*at, ts, id_col)
    names = dealt.columns

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches cut between bursts."""
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            changes = np.zeros(batch.num_rows - 1, dtype=bool)
            for k in at:
                col = batch.column(names.index(k))
                changes |= pc.fill_null(pc.not_equal(col[1:], col[:-1]), True).to_numpy(zero_copy_only=False) & ~(col[1:].is_null().to_numpy(zero_copy_only=False) & col[:-1].is_null().to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(changes)
            cut = int(cuts[-1]) + 1 if len(cuts) else 0
            rest = batch.slice(cut)
            if cut:
                yield batch.slice(0, cut), np.append(cuts[:-1] + 1, cut)
        if rest is not None and rest.num_rows:
            yield rest, np.array([rest.num_rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ends in whole(batches):
            own = pc.fill_null(batch.column(names.index(bits)), 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).tolist()
            label, keep, begin = np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=bool), 0
            for end in ends.tolist():
                label[begin:end] = subgroups(own[begin:end], most)
                keep[begin:end] = np.bincount(label[begin:end])[label[begin:end]] > 1
                begin = end
            kept = pa.Table.from_batches([batch]).append_column("subgroup", pa.array(label)).filter(pa.array(keep))
            yield from kept.combine_chunks().to_batches()

    ship(grouped.sparkSession)
    return dealt.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", subgroup bigint")


def motion_peak(pairs: DataFrame, group: str, pos: str, magnitude: str, window: int = c.MOTION_WINDOW) -> DataFrame:
    """(group, peak_pos, peak): the left frame of the strongest pair among those around the middle.

    pairs: one row for each two consecutive frames of a group, pos from 0, in order.
    """
    n = pairs.groupBy(group).agg(F.count("*").alias("_n"))
    half = window // 2
    mid = F.floor(F.col("_n") / 2)
    near = pairs.join(n, group).where((F.col(pos) >= mid - half) & (F.col(pos) < mid + half + 1))
    order = Window.partitionBy(group).orderBy(F.col(magnitude).desc(), F.col(pos))
    return near.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(group, F.col(pos).alias("peak_pos"), F.col(magnitude).alias("peak"))
