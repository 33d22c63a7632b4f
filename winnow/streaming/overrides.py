"""The override log as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as c
from ..operators.feedback import gate, train, training_rows
from ..sources import versions
from ..sources.files import OVERRIDE, read_overrides


def read(spark: SparkSession, path: str, schema: str = OVERRIDE) -> DataFrame:
    """New entries as files arrive; blank and malformed lines are skipped."""
    rows = spark.readStream.text(path).where(F.trim("value") != "")
    return rows.select(F.from_json("value", schema).alias("e")).where("e is not null and e.path is not null").select("e.*")


def label_counts(entries: DataFrame) -> DataFrame:
    """Running tallies per label; for update or complete mode."""
    return entries.groupBy("user_decision").agg(F.count("*").alias("n"))


def windowed_counts(entries: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Tallies per label and time window; entries later than `late` are dropped, so state stays bounded."""
    return entries.withWatermark("timestamp", late).groupBy(F.window("timestamp", width), "user_decision").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "user_decision", "n")


def burst_sessions(captures: DataFrame, key: str, ts: str, gap: str = "500 milliseconds", late: str = "1 hour") -> DataFrame:
    """Bursts of two or more over a stream of captures; a capture exactly `gap` after the last one joins."""
    found = captures.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("burst_size"))
    return found.where("burst_size > 1").select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "burst_size")


def retrain(entries: DataFrame, log_path: str, checkpoint: str, state_path: str, publish: Callable, needed: int = c.RETRAIN_BATCH):
    """A query that trains on the whole log whenever `needed` more entries have come, and hands the model to publish.

    The count lives in a versioned table in state_path, with the batch it was last raised by: a batch that runs again after
    a failure does not count twice.  No table means no count yet; a table that can't be read is an error.
    """
    spark = entries.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        table = versions.read(spark, state_path)
        state = table.first() if table is not None else None
        if state is not None and state.batch >= number:
            return
        total, due = gate(state.total if state is not None else 0, batch.count(), needed)
        if due:
            model = train(training_rows(read_overrides(spark, log_path)))
            if model is not None:
                publish(model)
        versions.commit(spark.createDataFrame([(number, total)], "batch bigint, total bigint").coalesce(1), state_path)

    return entries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


MODEL = "batch bigint, feature string, weight double"
#: The feature name of the intercept.
INTERCEPT = ""


def weights(spark: SparkSession, model_path: str) -> tuple[int, dict[str, float]]:
    """(last batch learned from, weight by feature) of the model in model_path; -1 and no weights if there is none yet."""
    table = versions.read(spark, model_path)
    rows = [] if table is None else table.collect()  # a row for each feature
    return max((r.batch for r in rows), default=-1), {r.feature: r.weight for r in rows}


def gradient(entries: DataFrame, model: dict[str, float]) -> dict[str, float]:
    """The gradient of the logistic loss over all entries, by feature: summed in the executors, a row for each feature comes
    back.  Missing and null scores count as 0, and an entry is a keeper (1) or not (0)."""
    known = F.map_from_arrays(F.array(*[F.lit(k) for k in model]), F.array(*[F.lit(float(w)) for w in model.values()])) if model else F.expr("cast(map() as map<string,double>)")
    own = F.filter(F.map_entries(F.coalesce("stage1_scores", F.expr("cast(map() as map<string,double>)"))), lambda e: e["value"].isNotNull())
    own = F.concat(own, F.array(F.struct(F.lit(INTERCEPT).alias("key"), F.lit(1.0).alias("value"))))
    weight = lambda e: F.coalesce(F.try_element_at(F.col("w"), e["key"]), F.lit(0.0))
    z = F.aggregate("x", F.lit(0.0), lambda s, e: s + weight(e) * e["value"])
    rows = entries.select(own.alias("x"), known.alias("w"), F.when(F.col("user_decision") == "keeper", 1.0).otherwise(0.0).alias("label"))
    rows = rows.select("x", (1 / (1 + F.exp(-F.least(F.lit(700.0), F.greatest(F.lit(-700.0), z)))) - F.col("label")).alias("off"))
    sums = rows.select(F.explode("x").alias("e"), "off").groupBy(F.col("e.key").alias("feature")).agg(F.sum(F.col("off") * F.col("e.value")).alias("g"))
    return {r.feature: r.g for r in sums.collect()}


def learn(entries: DataFrame, checkpoint: str, model_path: str, rate: float = 0.01):
    """A query that takes one step of gradient descent for each batch of entries and keeps the model in model_path.

    The model is a versioned table with the batch that made it: a batch that runs again after a failure, be it before or after
    its model was committed, is learned from once.
    """
    spark = entries.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        last, model = weights(spark, model_path)
        if last >= number:
            return
        step = gradient(batch, model)
        after = {k: model.get(k, 0.0) - rate * step.get(k, 0.0) for k in {INTERCEPT, *model, *step}}
        rows = [(number, k, w) for k, w in sorted(after.items())]
        versions.commit(spark.createDataFrame(rows, MODEL).coalesce(1), model_path)

    return entries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def taste(rows: DataFrame, scores: str, model: dict[str, float]) -> Column:
    """The probability that the model gives to a keeper; 0.5 without a model."""
    if not model:
        return F.lit(0.5)
    z = F.lit(model.get(INTERCEPT, 0.0))
    for k, w in model.items():
        if k != INTERCEPT:
            z = z + F.lit(w) * F.coalesce(F.try_element_at(rows[scores], F.lit(k)), F.lit(0.0))
    return 1 / (1 + F.exp(-F.least(F.lit(700.0), F.greatest(F.lit(-700.0), z))))
