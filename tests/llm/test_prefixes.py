"""What prefixes of near-dedup take first."""

import numpy as np
from pyspark.sql import functions as F

from winnow.llm import simhash


def test_prefixes_take_shingles_of_one_text_before_those_of_two(spark):
    text = lambda i: " ".join([f"both{i // 2}x{k}" for k in range(30)] + [f"own{i}x{k}" for k in range(30)])
    df = spark.createDataFrame([(i, text(i)) for i in range(40)], "doc_id bigint, text string")
    prefix = simhash.Prefix(0.8, *simhash.common_shingles(df, "text", 5))
    rows = simhash.fingerprints(df, ("doc_id",), "text", 5, True, 1, prefix).collect()
    held = np.concatenate([np.frombuffer(r.prefix, np.uint64) for r in rows])
    assert len(held) == 40 * 12 and len(np.unique(held)) == len(held)


def test_levels_grow_with_counts_and_leave_out_what_does_not_fit(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLOTS", 64)
    monkeypatch.setattr(simhash, "PART", 16)
    repeated = spark.range(48).select(F.col("id").alias("hash"), F.when(F.col("id") < 10, 2).when(F.col("id") < 30, 4).otherwise(64).cast("bigint").alias("n"))
    levels = simhash.shingle_levels(repeated)
    assert len(levels) == 64 and not levels[:30].any() and (levels[30:48] == 48).all() and not levels[48:].any()  # 18 of 32 slots; 20 more would not fit
    assert simhash.shingle_levels(repeated.where("n = 2")).tolist() == [8] * 10 + [0] * 54
    assert len(simhash.shingle_levels(repeated.limit(0))) == 0
