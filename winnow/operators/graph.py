"""Graphs as edge tables: connected components, and the first maximal independent set by id."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import drop_scratch, scratch, ship


def _mark(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node id that can be reached.

    Alternating star contractions: each round is two aggregations with map-side combine and two equi-joins whose one
    side is unique per key, so a node with any number of neighbours never has to fit in one task.  Only two numbers a
    round (rows and a checksum, to see that nothing moved) reach the driver.  Edges may repeat, point either way or
    be loops; a null end drops the edge.  No edges: no rows.
    """
    x, y = F.col(a), F.col(b)
    pairs = scratch(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    before = _mark(pairs)
    for _ in range(max_rounds if before[0] else 0):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        after = scratch(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct(), "edges")
        mark = _mark(after)
        drop_scratch(pairs)
        pairs = after
        if mark == before:
            break
        before = mark
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


_STATES = "v {kind}, u {kind}, state int"
#: What a row of a node says: it has an undecided neighbour u below it; u is a source; it is decided so itself.
OPEN, HEAD, COVERED, SOURCE = 0, 1, 2, 3


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over rows (v, u, state) in order of v: a decided node's one row (v, null, COVERED or SOURCE), and the rows
    that an undecided one still waits for.

    u is a neighbour below v, or null in the row that every undecided node has.  A node is covered if a neighbour below
    is a source, and a source if all of them are covered; rows of the nodes before it in this task are decided first.
    """
    known: dict = {}  # of the nodes of this task
    node, rows, covered = None, [], False

    def close() -> list[tuple]:
        if node is None:
            return []
        waits = [u for u in rows if known.get(u) != COVERED]
        if covered or any(known.get(u) == SOURCE for u in waits):
            known[node] = COVERED
        elif not waits:
            known[node] = SOURCE
        else:
            return [(node, None, OPEN), *((node, u, OPEN) for u in waits)]
        return [(node, None, known[node])]

    def table(out: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), like.schema)], schema=like.schema)

    batch = None
    for batch in batches:
        out = []
        for v, u, state in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if v != node:
                out += close()
                node, rows, covered = v, [], False
            covered |= state == HEAD
            if u is not None and not covered:
                rows.append(u)
        if out:
            yield table(out, batch)
    if batch is not None:
        out = close()
        if out:
            yield table(out, batch)


def first_independent_set(edges: DataFrame, a: str, b: str, block_rows: int = 1 << 20) -> DataFrame:
    """(node, is_source) for every node of an edge: sources are what a greedy pass over ids in order would take.

    Block-sequential: nodes are dealt by ranges of id into blocks of about `block_rows` rows, each node with its
    neighbours below it.  A round is one pass over every block in order of id, which decides all nodes that depend only on
    decided ones and on each other; the decisions are then carried across edges to later blocks.  The first block that
    has undecided nodes decides all of them, so rounds end, at the latest after one a block; chains inside a
    block, however long, take no rounds of their own.  Edges may repeat, point either way or be loops; a null end
    drops the edge.  No edges: no rows.
    """
    x, y = F.col(a), F.col(b)
    spark = edges.sparkSession
    ship(spark)
    linked = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("v"), F.least(x, y).alias("u"))
    none = F.lit(None).cast(linked.schema["u"].dataType)
    rows = scratch(linked.select(F.explode(F.array(F.struct("v", "u"), F.struct("v", none.alias("u")), F.struct(F.col("u").alias("v"), none.alias("u")))).alias("r")).select("r.*").distinct(), "below")
    kind, total = rows.schema["v"].dataType.simpleString(), rows.count()
    blocks = max(1, -(-total // block_rows))
    schema = _STATES.format(kind=kind)
    dealt = rows.withColumn("state", F.lit(OPEN)).repartitionByRange(blocks, "v").sortWithinPartitions("v", "u")
    decided = []
    for _ in range(blocks + 1):
        done = scratch(dealt.mapInArrow(_decide, schema).withColumn("block", F.spark_partition_id()), "decided")
        decided.append(done.where(F.col("state").isin(COVERED, SOURCE)).select(F.col("v").alias("node"), (F.col("state") == SOURCE).alias("is_source")))
        left = done.where(F.col("state") == OPEN).select("v", "u", "block")
        if blocks == 1 or left.isEmpty():
            break
        # what this round decided of the neighbours below that lie in other blocks
        told = left.join(decided[-1].withColumnRenamed("node", "u"), "u", "left").where("is_source is null or is_source")
        told = told.select("v", "u", F.when(F.col("is_source"), F.lit(HEAD)).otherwise(F.lit(OPEN)).alias("state"), "block")
        dealt = told.repartition(blocks, "block").sortWithinPartitions("v", F.col("state").desc(), "u").drop("block")
    else:
        raise RuntimeError("first_independent_set did not settle")
    out = decided[0]
    for one in decided[1:]:
        out = out.unionByName(one)
    return out
