"""Learning from overrides: the taste model."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as c


def training_rows(overrides: DataFrame) -> DataFrame:
    """(label, features): 1 for keeper, else 0; scores by sorted key."""
    entries = F.transform(F.array_sort(F.map_entries("stage1_scores")), lambda e: e["value"])
    return overrides.select(F.when(F.col("user_decision") == "keeper", 1.0).otherwise(0.0).alias("label"), array_to_vector(entries).alias("features"))


def train(rows: DataFrame, max_iter: int = 1000) -> LogisticRegressionModel | None:
    """A logistic model with balanced classes; None if only one class is there."""
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    if len(counts) < 2:
        return None
    n = sum(counts.values())
    weight = F.when(F.col("label") == 1.0, n / (2 * counts[1.0])).otherwise(n / (2 * counts[0.0]))
    model = LogisticRegression(maxIter=max_iter, regParam=1 / n, standardization=False, weightCol="weight")
    return model.fit(rows.withColumn("weight", weight))


def learn_online(weights: dict[int, float], rows: Iterable[tuple[float, Sequence[float]]], rate: float = 0.01) -> dict[int, float]:
    """Weights by feature (-1: intercept) of a logistic model after one step of gradient descent for each (label, features),
    in order.  Steps follow one another by definition, so this takes the rows of one small batch of a stream."""
    out = dict(weights)
    for label, features in rows:
        z = out.get(-1, 0.0) + sum(out.get(i, 0.0) * x for i, x in enumerate(features))
        off = 1 / (1 + math.exp(-max(-700.0, min(700.0, z)))) - label
        out[-1] = out.get(-1, 0.0) - rate * off
        for i, x in enumerate(features):
            out[i] = out.get(i, 0.0) - rate * off * x
    return out


# Fixed value: what versions of a profile are called, before the number of labels.
VERSION = "logreg-v"


def save_profile(model: LogisticRegressionModel, labels: int, path: str) -> None:
    """Keeps a model and how many labels it was trained on, in a folder that all executors share."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(labels, f"{VERSION}{labels}")], "labels bigint, version string").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load_profile(spark: SparkSession, path: str) -> tuple[LogisticRegressionModel, int, str] | None:
    """(model, labels, version); None if there is no profile or it can't be read."""
    try:
        about = spark.read.schema("labels bigint, version string").json(f"{path}/about").first()
        return (LogisticRegressionModel.load(f"{path}/model"), about.labels, about.version) if about else None
    except (AnalysisException, Py4JJavaError):
        return None


def gate(count: int, batch: int, needed: int = c.RETRAIN_BATCH) -> tuple[int, bool]:
    """(new count, whether to train): the count starts anew once it has reached `needed`."""
    total = count + batch
    return (0, True) if total >= needed else (total, False)


def score(df: DataFrame, features: str, model: LogisticRegressionModel | None, labels: int) -> DataFrame:
    """df with taste, taste_labels, taste_weight and taste_source; neutral while cold (no model or under five labels)."""
    if model is None or labels < c.TASTE_MIN_LABELS:
        return df.withColumns({"taste": F.lit(0.5), "taste_labels": F.lit(0), "taste_weight": F.lit(0.0), "taste_source": F.lit("warmstart")})
    scored = model.setProbabilityCol("_p").transform(df.withColumn("features", array_to_vector(F.col(features))))
    ramp = min(labels / c.TASTE_RAMP, 1.0)
    return scored.withColumns({"taste": vector_to_array("_p")[1], "taste_labels": F.lit(labels), "taste_weight": F.lit(ramp), "taste_source": F.lit("trained")}).select(*df.columns, "taste", "taste_labels", "taste_weight", "taste_source")
