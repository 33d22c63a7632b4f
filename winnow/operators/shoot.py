"""Statistics of a whole shoot joined back to its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as c
from .medians import medians
from .ranking import ranked


def _outlier(d: Column, scale: Column, sigma: float) -> Column:
    return F.when(scale <= 1e-6, F.lit(0.0)).otherwise(F.least(F.lit(1.0), d / scale * sigma))


def outliers(df: DataFrame, keys: list[str], palette: tuple[str, str, str], exposure: str) -> DataFrame:
    """df with palette_outlier and exposure_drift: distance from the shoot's median over the largest, times sigma.

    A null palette counts as the zero vector.  Medians and scales are one row per shoot, joined back by key; no task holds
    the values of a large shoot.
    """
    lab = [F.coalesce(F.col(p), F.lit(0.0)) for p in palette]
    middle = medians(df, keys, {f"_m{i}": x for i, x in enumerate(lab)} | {"_me": F.col(exposure)})
    near = df.join(middle, keys).withColumns({
        "_dp": F.sqrt(sum((x - F.col(f"_m{i}")) * (x - F.col(f"_m{i}")) for i, x in enumerate(lab))),
        "_de": F.abs(F.col(exposure) - F.col("_me")),
    })
    scales = near.groupBy(*keys).agg(F.max("_dp").alias("_sp"), F.max("_de").alias("_se"))
    return near.join(scales, keys).select(*df.columns, _outlier(F.col("_dp"), F.col("_sp"), c.PALETTE_SIGMA).alias("palette_outlier"), _outlier(F.col("_de"), F.col("_se"), c.EXPOSURE_SIGMA).alias("exposure_drift"))


def modes(df: DataFrame, keys: list[str], columns: list[str], pos: str) -> DataFrame:
    """One row per shoot with mode_<column>: the commonest value, nulls ignored; the first seen wins a tie."""
    long = df.select(*keys, pos, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in columns])).alias("e")).where("e.v is not null")
    counts = long.groupBy(*keys, "e.k", "e.v").agg(F.count("*").alias("n"), F.min(pos).alias("at"))
    best = counts.groupBy(*keys, "k").agg(F.max(F.struct("n", (-F.col("at")).alias("at"), "v"))["v"].alias("v"))
    return best.groupBy(*keys).pivot("k", columns).agg(F.first("v")).select(*keys, *[F.col(k).alias(f"mode_{k}") for k in columns])


def anomalies(df: DataFrame, keys: list[str], columns: list[str], pos: str, sigma: float = c.EXIF_SIGMA) -> DataFrame:
    """df with exif_anomaly: min(1, f * sigma / k), f the share of the k known modes that a row's values miss."""
    joined = df.join(modes(df, keys, columns, pos), keys, "left")
    known = sum(F.col(f"mode_{k}").isNotNull().cast("int") for k in columns)
    missed = sum((F.col(f"mode_{k}").isNotNull() & ~F.col(k).cast("string").eqNullSafe(F.col(f"mode_{k}"))).cast("int") for k in columns)
    score = F.when(known == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), missed / known * sigma / known))
    return joined.select(*df.columns, score.alias("exif_anomaly"))


def first_position(df: DataFrame, keys: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """df with each row's position in its shoot, from 0."""
    return ranked(df, order, name, keys)
