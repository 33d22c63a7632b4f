"""Exact medians by counts over ranges, against plain sorting; the largest task holds a part of a key's rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from winnow.operators import sequence
from winnow.operators.medians import medians


def plain(values):
    xs = sorted((x for x in values if x is not None), key=lambda x: (math.isnan(x), x))
    if not xs:
        return None
    return 0.5 * xs[(len(xs) - 1) // 2] + 0.5 * xs[len(xs) // 2]


def same(a, b):
    return a == b or a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-12))


@pytest.mark.parametrize("ranges, few", [(4, 3), (64, 10), (4096, 4096)])
def test_medians_equal_plain_sorting(spark, ranges, few):
    r = random.Random(5)
    odd = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 1e308, -1e308, 5e-324]
    data = []
    for k, n in (("a", 501), ("b", 40), (None, 33), ("ties", 200), ("few", 1), ("two", 2), ("none", 3), ("odd", 9)):
        for i in range(n):
            x = r.gauss(0, 10.0 ** r.randrange(-3, 6))
            y = float(r.randrange(3))
            data.append((k, odd[i] if k == "odd" else None if k == "none" else 7.0 if k == "ties" else x, y if r.random() < 0.9 else None, r.choice(odd)))
    df = spark.createDataFrame(data, "k string, x double, y double, z double").repartition(3)
    got = {r_.k: r_ for r_ in medians(df, ["k"], {"mx": F.col("x"), "my": F.col("y"), "mz": F.col("z")}, task_rows=1, ranges=ranges, few=few).collect()}
    assert set(got) == {k for k, *_ in data}
    for k in got:
        for c, name in ((1, "mx"), (2, "my"), (3, "mz")):
            want = plain([row[c] for row in data if row[0] == k])
            assert same(got[k][name], want), (k, name, got[k][name], want)


def test_both_ways_agree_and_empty_tables(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "cast(id * 37 % 101 as double) as x")
    one, two = ({r.k: r.m for r in medians(df, ["k"], {"m": F.col("x")}, task_rows=n).collect()} for n in (1 << 20, 1))
    assert one == two
    assert medians(df, [], {"m": F.col("x")}, task_rows=1).first().m == df.agg(F.median("x")).first()[0]
    assert medians(df.limit(0), ["k"], {"m": F.col("x")}).count() == 0
    assert medians(df.limit(0), [], {"m": F.col("x")}).first().m is None


def test_a_dense_day_of_one_shoot_is_dealt_over_many_ranges(spark):
    rows = [(k, "s", (k * 7919 % 4001) / 4 if k % 50 else None) for k in range(1500)]
    df = spark.createDataFrame(rows, "id int, shoot string, o double").select("id", "shoot", F.timestamp_micros((F.col("o") * 1e6).cast("bigint")).alias("ts"))
    want, before, run = {}, None, 0
    for o, k in sorted((-1.0 if o is None else o, k) for k, _, o in rows):
        run += before is None or o < 0 or o - before > 0.5
        before = None if o < 0 else o
        want[k] = run
    sizes = {}
    for b in want.values():
        sizes[b] = sizes.get(b, 0) + 1
    for ranges in (1, 9):
        got = {r.id: (r.burst, r.burst_size) for r in sequence.bursts(df, ["shoot"], "ts", "id", 0.5, ranges).collect()}
        assert got == {k: (b, sizes[b]) for k, b in want.items() if sizes[b] > 1}
    dealt = sequence._running(df, ["shoot"], "ts", "id", lambda now, before: F.lit(1), 9)
    assert dealt.select(F.max("_run")).first()[0] == 1500
