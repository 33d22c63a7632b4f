"""Exact medians of groups of any size, without a task that holds a group.

A group's values are counted in ranges of value (map-side combined, so a range costs one row a task), the range that holds
the wanted rank is cut into ranges again, and what is left after two or three passes is few rows or one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import drop_scratch, scratch

RANGES = 4096
INF = float("inf")


def _cell(x: Column, lo: Column, hi: Column, ranges: int) -> Column:
    """The range of x in lo..hi, from 0; never smaller for a larger x.  Values that are no finite numbers have cells of their
    own: -inf before, then after all others inf and NaN, as values are ordered."""
    wide = F.greatest(F.abs(lo), F.abs(hi)) > 1e300  # their difference could be no finite number
    share = F.when(wide, F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2)).otherwise(F.try_divide(x - lo, hi - lo))
    place = F.floor(share * ranges)
    inside = F.when(lo == hi, F.lit(0)).otherwise(F.least(F.lit(ranges - 1), F.greatest(F.lit(0), place)))
    return F.when(F.isnan(x), F.lit(ranges + 1)).when(x == INF, F.lit(ranges)).when(x == -INF, F.lit(-1)).otherwise(inside).cast("int")


def medians(df: DataFrame, keys: Sequence[str], columns: dict[str, Column], task_rows: int = 1 << 20, ranges: int = RANGES, few: int = 4096) -> DataFrame:
    """One row for each value of keys in df: the keys, and of each of columns (name -> expression) the exact median.

    As the built-in median: the mean of the two middle values, nulls left out, null where none is left; NaN is the
    largest value; null keys are a group; an empty table gives no rows (one row of nulls without keys).  Groups of at
    most task_rows rows each use the built-in one; beyond that values are selected by counts over ranges, and only
    ranges with at most `few` values are ever gathered.
    """
    aggs = [F.median(x.cast("double")).alias(name) for name, x in columns.items()]
    names = {f"_k{i}": k for i, k in enumerate(keys)}
    own = list(names)
    wide = df.select(*[F.col(k).alias(n) for n, k in names.items()], *[x.cast("double").alias(f"_c{i}") for i, x in enumerate(columns.values())])
    largest = wide.groupBy(*own).count().agg(F.max("count")).first()[0]
    if largest is None or largest <= task_rows:
        return df.groupBy(*keys).agg(*aggs)
    long = wide.select(*own, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_c{i}").alias("x")) for i in range(len(columns))])).alias("e")).select(*own, "e.i", "e.x").where("x is not null")
    long = scratch(long, "values")
    finite = F.when(~F.isnan("x") & (F.abs("x") != INF), F.col("x"))
    sizes = long.groupBy(*own, "i").agg(F.count("*").alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    # two ranks of each group and column, from 0; lo and hi: the range that each is known to lie in
    rank = F.explode(F.array(F.struct(F.lit(0).alias("t"), F.floor((F.col("n") - 1) / 2).alias("rank")), F.struct(F.lit(1).alias("t"), F.floor(F.col("n") / 2).alias("rank"))))
    wanted = scratch(sizes.select(*own, "i", F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(0.0)).alias("hi"), F.lit(True).alias("odd"), rank.alias("r")).select(*own, "i", "r.t", "r.rank", "lo", "hi", "odd"), "wanted")
    found = []
    rest = long
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in own]
    while True:
        spans = wanted.select(*own, "i", "lo", "hi", "odd").distinct()
        # values within a span still looked at; values that are no finite numbers only in the first pass (odd)
        within = (rest["x"] >= spans["lo"]) & (rest["x"] <= spans["hi"]) & (F.abs(rest["x"]) != INF) & ~F.isnan(rest["x"])
        met = rest.join(spans, [*same(rest, spans), rest["i"] == spans["i"], within | spans["odd"]]).select(*[rest[k] for k in own], rest["i"], "x", "lo", "hi")
        cells = met.withColumn("cell", _cell(F.col("x"), F.col("lo"), F.col("hi"), ranges))
        counts = cells.groupBy(*own, "i", "lo", "hi", "cell").agg(F.count("*").alias("m"), F.min("x").alias("a"), F.max("x").alias("z"))
        upto = Window.partitionBy(*own, "i", "lo", "hi").orderBy("cell")  # a row for each range
        counts = scratch(counts.withColumn("past", F.sum("m").over(upto)).withColumn("before", F.col("past") - F.col("m")), "counts")
        at = counts.join(wanted, [*same(counts, wanted), *(counts[k] == wanted[k] for k in ("i", "lo", "hi")), counts["before"] <= wanted["rank"], wanted["rank"] < counts["past"]])
        at = at.select(*[counts[k] for k in own], counts["i"], "t", (F.col("rank") - F.col("before")).alias("rank"), F.col("a").alias("lo"), F.col("z").alias("hi"), "m")
        one = F.col("lo").eqNullSafe(F.col("hi"))
        at = scratch(at, "narrowed")
        found.append(at.where(one).select(*own, "i", "t", F.col("lo").alias("value")))
        open_ = at.where(~one)
        most = open_.agg(F.max("m")).first()[0]
        if most is None:
            break
        if most <= few:
            spans = open_.select(*own, "i", "lo", "hi").distinct()
            met = long.join(spans, [*same(long, spans), long["i"] == spans["i"], long["x"] >= spans["lo"], long["x"] <= spans["hi"]])
            left = met.select(*[long[k] for k in own], long["i"], "lo", "hi", "x").groupBy(*own, "i", "lo", "hi").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # `few` values at most
            hit = open_.join(left, [*same(open_, left), *(open_[k] == left[k] for k in ("i", "lo", "hi"))])
            found.append(hit.select(*[open_[k] for k in own], open_["i"], "t", F.get("xs", F.col("rank").cast("int")).alias("value")))
            break
        wanted = scratch(open_.select(*own, "i", "t", "rank", "lo", "hi", F.lit(False).alias("odd")), "wanted")
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    # two values of each group and column
    halves = every.groupBy(*own, "i").agg((F.sum(F.col("value") * 0.5)).alias("median"))
    rows = halves.groupBy(*own).agg(*[F.max(F.when(F.col("i") == i, F.col("median"))).alias(name) for i, name in enumerate(columns)])
    groups = wide.select(*own).distinct()
    out = scratch(groups.join(rows, same(groups, rows), "left").select(*[groups[n].alias(k) for n, k in names.items()], *columns) if own else rows.select(*columns), "medians")
    drop_scratch(long)
    return out
