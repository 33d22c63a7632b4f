"""Mixing sources to target weights, in DataFrame operations only.

Tokens are summed per source (map-side combined, so a hot source costs one row a task), targets follow by water
filling over the sources, and each document gets floor(rate) copies plus one more with probability equal to the
rate's fraction, decided by a seeded hash of the document: reruns agree, and no order of rows matters.

Draws alone leave a source of few, uneven documents far from its target.  So every source makes its Bernoulli draws with
`tries` seeds and keeps those whose words come nearest its target (rejective sampling).  The words that each seed would
take are sums like the others: one row a source and task, whatever the source's size.

The table of sources is broadcast only if it has at most `broadcast_sources` rows; beyond that it is joined by
source and salt, each source's row repeated per salt, so a hot source is spread over `salts` tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kit import drop_scratch, scratch

WORDS = r"[^\x20\x09-\x0D]+"
MOST = 3.0


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = MOST, share: float = 1.0) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    Sources by code point, null last, take the weights in turn.  Targets are weight times one level, at most
    `most` times the source's size, where the level makes them sum to share times all sizes: what a capped source
    leaves goes to the others by weight.  Sources without words get 0.  The windows here run over one row per source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("fill", F.col("cap") / F.col("weight"))
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before, everything = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    )
    # the first source whose cap is not reached sets the level for all from there on; if none, all are capped
    level = F.min(F.when(F.col("level") < F.col("fill"), F.struct("fill", "source", "level"))).over(everything)["level"]
    return ranked.withColumn("at", level).select("source", "source_size", "weight", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("at"))).alias("target"))


def _of_source(df: DataFrame, source: str, hashed: str, table: DataFrame, few: bool, salts: int) -> DataFrame:
    """df with the columns of table, which has one row per mix_source (nulls match)."""
    same = F.col(source).eqNullSafe(F.col("mix_source"))
    if few:
        return df.join(F.broadcast(table), same)
    salted = table.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("mix_of", F.pmod(F.col(hashed), F.lit(salts)).cast("int")).join(salted, same & (F.col("mix_of") == F.col("mix_salt"))).drop("mix_of", "mix_salt")


def draw(hashed: F.Column, k: F.Column) -> F.Column:
    """The k-th draw of a document, evenly spread over 0..1."""
    return F.shiftrightunsigned(F.xxhash64(hashed, k), 11) / F.lit(float(1 << 53))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = MOST, seed: int = 17, tries: int = 64, broadcast_sources: int = 50_000, salts: int = 64) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_copies and mix_draw (the seed of the source's draws), a row
    for every row of docs.

    A null or empty text has size 0; texts of any length count whole; a null source is a source of its own; rows with
    the same id and text draw alike; of seeds that come equally near the first is taken.  Other columns stay, but for
    those named mix_... as here, which are replaced.  An empty table gives an empty result.
    """
    docs = docs.drop("mix_size", "mix_hash", "mix_source", "mix_source_size", "mix_target", "mix_rate", "mix_draw", "mix_copies", "mix_of", "mix_salt", "mix_copy")
    sized = docs.withColumn("mix_size", word_count(F.col(text_col))).withColumn("mix_hash", F.xxhash64(F.lit(seed), id_col, F.xxhash64(text_col)))
    slim = scratch(sized.select(F.col(source_col).alias("source"), F.col("mix_size").alias("size"), F.col("mix_hash").alias("hash")), "sized")
    targets = scratch(source_targets(slim, weights, most), "sources")
    few = targets.count() <= broadcast_sources
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    rates = targets.select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), rate.alias("mix_rate"))
    fraction = F.col("mix_rate") - F.floor("mix_rate")
    drawn = _of_source(slim.where("size > 0"), "source", "hash", rates, few, salts)
    taken = drawn.groupBy("mix_source").agg(*[F.sum(F.when(draw(F.col("hash"), F.lit(k)) < fraction, F.col("size")).otherwise(0)).alias(f"t{k}") for k in range(tries)])
    off = lambda k: F.abs(F.floor("mix_rate") * F.col("mix_source_size") + F.coalesce(F.col(f"t{k}"), F.lit(0)) - F.col("mix_target"))
    best = F.array_min(F.array(*[F.struct(off(k).alias("off"), F.lit(k).alias("k")) for k in range(tries)]))["k"]
    plan = rates.alias("r").join(taken.withColumnRenamed("mix_source", "of"), F.col("mix_source").eqNullSafe(F.col("of")), "left").select("mix_source", "mix_source_size", "mix_target", "mix_rate", best.alias("mix_draw"))
    plan = scratch(plan, "draws")
    for done in (slim, targets):
        drop_scratch(done)
    joined = _of_source(sized, source_col, "mix_hash", plan, few, salts)
    copies = F.floor("mix_rate") + F.when(draw(F.col("mix_hash"), F.col("mix_draw")) < fraction, 1).otherwise(0)
    return joined.withColumn("mix_copies", copies.cast("int")).drop("mix_source", "mix_hash", "mix_rate")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs mix_copies times, with its columns and no others; nulls and repeats as in mix_plan."""
    plan = mix_plan(docs, **how)
    return plan.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*[c for c in docs.columns if c in plan.columns])


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """How often the mix takes every document; nulls, blanks, long texts, repeats and empty tables as in mix_plan."""
    plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return plan.select(
        "doc_id", "source", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.col("mix_copies").cast("bigint").alias("copies"),
    )


ORACLE_SQL: dict[str, str] = {}
