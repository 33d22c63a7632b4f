"""Bursts, winners and subgroups over a stream of captures, with state per shoot and timers in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import config as c
from ..operators.sequence import subgroups
from ..tables import ship

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Bursts(StatefulProcessor):
    """Keeps the captures of a shoot until the watermark says that nothing can join their burst any more."""

    #: What is kept of a capture: microseconds, id, score, hash.
    WAITING = "us bigint, id bigint, score double, bits bigint"

    def __init__(self, gap_us: int, most_bits: int):
        self.gap, self.most = gap_us, most_bits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITING)

    def _runs(self, rows: list[tuple]) -> list[list[tuple]]:
        out: list[list[tuple]] = []
        for row in sorted(rows):
            if out and row[0] - out[-1][-1][0] <= self.gap:
                out[-1].append(row)
            else:
                out.append([row])
        return out

    def _closes(self, run: list[tuple]) -> int:
        """The millisecond after which no capture that is not late can join."""
        return (run[-1][0] + self.gap) // 1000 + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = [tuple(x) for x in self.waiting.get()]
        for pdf in rows:
            known += [(int(us), int(i), float(s), int(b)) for us, i, s, b in zip(pdf["us"], pdf["id"], pdf["score"], pdf["bits"])]
        # a capture that comes between two runs joins them: timers set for what they were then find nothing closed
        self.waiting.put(known)
        for run in self._runs(known):
            self.handle.registerTimer(self._closes(run))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, open_, out = timerValues.getCurrentWatermarkInMs(), [], []
        for run in self._runs([tuple(x) for x in self.waiting.get()]):
            if self._closes(run) > now:
                open_ += run
            elif len(run) > 1:
                order = sorted(range(len(run)), key=lambda i: (-run[i][2], run[i][0], run[i][1]))
                rank = {i: r + 1 for r, i in enumerate(order)}
                label = subgroups([x[3] & (1 << 64) - 1 for x in run], self.most)
                out += [(*key, run[0][0], row[1], row[0], len(run), rank[i], rank[i] == 1, label[i], label.count(label[i])) for i, row in enumerate(run)]
        if open_:
            self.waiting.put(open_)
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["shoot", "start_us", "id", "us", "burst_size", "burst_rank", "is_burst_winner", "subgroup", "subgroup_size"]) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def burst_members(captures: DataFrame, shoot: str, ts: str, id_col: str, score: str, bits: str | None = None, gap: float = c.BURST_GAP, most: int = c.HAMMING_MAX, late: str = "1 hour") -> DataFrame:
    """A stream with a row for each member of each burst of two or more, once the burst is over: shoot, start, id, ts,
    burst_size, burst_rank, is_burst_winner, subgroup and subgroup_size.

    Equal to bursts(), rank_bursts() and leader_groups() of the same captures: a capture joins the one before it at a gap of
    at most `gap` seconds, missing scores count as 0, missing hashes as no bits, and without `bits` a burst is one subgroup.
    Captures without a time or shoot, and those that come later than `late`, are left out.  A burst is over when the
    watermark passes its last capture by the gap; then its state goes, so state holds open bursts only.  Ids are
    whole numbers.  For append mode; the session's state store must be RocksDB (set here for the session).
    """
    spark = captures.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    ship(spark)
    hashed = F.coalesce(F.col(bits).cast("bigint"), F.lit(0).cast("bigint")) if bits else F.lit(0).cast("bigint")
    slim = captures.withWatermark(ts, late).where(F.col(ts).isNotNull() & F.col(shoot).isNotNull())
    slim = slim.select(F.col(shoot).alias("shoot"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("us"), F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"), hashed.alias("bits"))
    kind = slim.schema["shoot"].dataType.simpleString()
    out = f"shoot {kind}, start_us bigint, id bigint, us bigint, burst_size bigint, burst_rank int, is_burst_winner boolean, subgroup bigint, subgroup_size bigint"
    found = slim.groupBy("shoot").transformWithStateInPandas(Bursts(round(gap * 1e6), most), out, "Append", "EventTime")
    return found.select(F.col("shoot").alias(shoot), F.timestamp_micros("start_us").alias("start"), F.col("id").alias(id_col), F.timestamp_micros("us").alias(ts), "burst_size", "burst_rank", "is_burst_winner", "subgroup", "subgroup_size")
