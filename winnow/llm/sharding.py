"""Sharding by balanced label propagation, in DataFrame operations only.

Documents are linked by a link key (here: equal texts); a key's documents are a hyperedge.  Each document starts in
a shard drawn by hash.  In every round each link key names the shard with room that holds most of its documents, and
those in shards that hold fewer propose to move there.  Shards have quotas: a proposal from i to j passes if a hash of the document is under
the share that is open, which is the room left in j plus what j gives up to i in the same round.  Only counts by
(link key, shard), and 64 flows, leave the tasks; rounds end when hardly any document moves.

Linked documents propose; the rest are ballast that at last fills each shard to exactly its quota (law `rows`: counts
at most one apart).  Where linked documents alone exceed a quota, some of them are moved as well.

Slots are ranks within a shard.  They are computed from counts of (shard, hash range) cells, whose number follows
the number of documents, plus ranks inside a cell, so no shard is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kit import drop_scratch, hot_values, lookup, scratch, spread

CELL_ROWS = 4096


def _cells(rows: int) -> int:
    return 1 << max(5, min(24, (rows // CELL_ROWS).bit_length()))


def gapless_rank(df: DataFrame, part: list[str], order_hash: str, ties: list[str], name: str, rows: int) -> DataFrame:
    """df with name: ranks 0, 1, ... within part by (order_hash, ties).  order_hash: a bigint spread evenly."""
    bits = _cells(rows).bit_length() - 1
    cell = F.shiftrightunsigned(F.col(order_hash), 64 - bits)
    marked = df.withColumn("_cell", cell)
    sizes = marked.groupBy(*part, "_cell").agg(F.count("*").alias("_n"))
    # the prefix sums run over cells: CELL_ROWS times fewer rows than df, dealt by part
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(Window.partitionBy(*part).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*part, "_cell").orderBy(order_hash, *ties)
    ranked = marked.withColumn("_inside", F.row_number().over(inside) - 1)
    return ranked.join(offsets, [*part, "_cell"]).withColumn(name, F.col("_offset") + F.col("_inside")).drop("_cell", "_inside", "_offset")


def _counts(df: DataFrame, shards: int) -> list[int]:
    got = {r.shard: r.n for r in df.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
    return [got.get(k, 0) for k in range(shards)]


def propagate(state: DataFrame, quota: list[int], rounds: int, hot: list = ()) -> DataFrame:
    """state: link, draw (a hash), shard, _spread; only linked rows.  Moves rows towards their link's shard under quotas.

    hot: links that many rows share; their rows are dealt over many tasks.
    """
    shards = len(quota)
    for k in range(rounds):
        sizes = _counts(state, shards)
        held = state.groupBy("link", "shard").agg(F.count("*").alias("n")).withColumn("pull", F.struct("n", F.xxhash64("link", "shard").alias("tie")))
        roomy = [j for j in range(shards) if sizes[j] < quota[j]] or list(range(shards))
        best = F.max(F.when(F.col("shard").isin(roomy), F.struct("pull", "shard")))
        links = held.groupBy("link").agg(best.alias("best"), F.collect_list(F.struct("shard", "pull")).alias("pulls"))  # a pull for each shard at most
        # a document goes where more of its link are than where it is; those in a full shard that leads stay
        goal = F.map_from_entries(F.transform("pulls", lambda x: F.struct(x["shard"], F.when(F.col("best.pull") > x["pull"], F.col("best.shard")).otherwise(x["shard"]))))
        proposed = lookup(state, "link", links.select("link", goal.alias("goal")), hot, "_spread").withColumn("to", F.element_at("goal", F.col("shard"))).select(*state.columns, "to")
        flows = {(r.shard, r.to): r.n for r in proposed.where("shard != to").groupBy("shard", "to").agg(F.count("*").alias("n")).collect()}  # shards squared at most
        shares = {}
        for (i, j), n in flows.items():
            swap = min(n, flows.get((j, i), 0))
            room = max(0, quota[j] - sizes[j])
            asked = sum(m - min(m, flows.get((j, a), 0)) for (a, b), m in flows.items() if b == j)
            shares[i, j] = min(1.0, (swap + (room * (n - swap) / asked if asked else 0)) / n)
        if not shares:
            break
        share = F.coalesce(F.create_map(*[x for (i, j), v in shares.items() for x in (F.lit(i * shards + j), F.lit(v))])[F.col("shard") * shards + F.col("to")], F.lit(0.0))
        draw = F.shiftrightunsigned(F.xxhash64("draw", F.lit(k)), 11) / F.lit(float(1 << 53))
        after = scratch(proposed.withColumn("shard", F.when(draw < share, F.col("to")).otherwise(F.col("shard"))).drop("to"), "labels")
        if k:
            drop_scratch(state)
        state = after
        if sum(n * shares[f] for f, n in flows.items()) < 0.001 * max(1, sum(sizes)):
            break
    return state


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: F.Column | None = None, shards: int = 8, rounds: int = 6, seed: int = 5) -> DataFrame:
    """One row per row of docs: id, size (UTF-8 bytes plus 1), text_crc32, shard, slot.

    link: the link key (default: the text, a null text being linked to nulls only); rows with a null key are not
    linked.  Ids may repeat or be null; repeated rows all get slots.  A null text has size 1, and texts of any length
    count whole; other columns are not read.  Shard counts are at most one apart; slots are gapless from 0 in each shard.
    Propagation ends when under a thousandth of the linked rows would still move, after `rounds` rounds at the latest: what
    it then leaves apart is cut, but every row has its shard.  An empty table gives an empty result.
    """
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    key = F.sha2(F.concat(F.when(F.col(text_col).isNull(), F.lit(b"0")).otherwise(F.lit(b"1")), raw), 256) if link is None else link.cast("string")
    slim = scratch(docs.select(F.col(id_col).alias("id"), (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(key).alias("link") if link is None else key.alias("link")), "slim")
    total = slim.count()
    quota = [total // shards + (k < total % shards) for k in range(shards)]
    groups = slim.where("link is not null").groupBy("link").agg(F.count("*").alias("n")).where("n > 1").select("link", F.lit(True).alias("linked"))
    hot = hot_values(slim, "link")
    drawn = lookup(spread(slim, "_spread"), "link", groups, hot, "_spread").withColumn("linked", F.coalesce("linked", F.lit(False))).withColumn("draw", F.xxhash64(F.lit(seed), "id", "text_crc32", "size"))
    drawn = scratch(drawn.withColumn("shard", F.pmod(F.xxhash64("draw"), F.lit(shards)).cast("int")), "drawn")
    tied = propagate(drawn.where("linked"), quota, rounds, hot)
    placed = scratch(tied.unionByName(drawn.where("not linked")), "placed")
    # ballast first, then linked rows of a shard, are beyond its quota: those go to the shards that lack rows
    free = {r.shard: r.n for r in placed.where("not linked").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    sizes = _counts(placed, shards)
    over = [max(0, sizes[k] - quota[k]) for k in range(shards)]
    ranked = gapless_rank(placed, ["shard", "linked"], "draw", ["id"], "rank", total)
    pick = F.lit(False)
    for k in range(shards):
        first, then = min(over[k], free.get(k, 0)), max(0, over[k] - free.get(k, 0))
        pick = pick | ((F.col("shard") == k) & (F.col("rank") < F.when(F.col("linked"), then).otherwise(first)))
    ranked = scratch(ranked.withColumn("spare", pick).drop("rank"), "ranked")
    spare = gapless_rank(ranked.where("spare").withColumn("all", F.lit(0)), ["all"], "draw", ["id"], "rank", total)
    goal, at = F.lit(None).cast("int"), sum(over)
    for k in reversed(range(shards)):
        lack = max(0, quota[k] - sizes[k])
        goal, at = F.when((F.col("rank") >= at - lack) & (F.col("rank") < at), k).otherwise(goal), at - lack
    moved = spare.withColumn("shard", goal.cast("int")).drop("rank", "all")
    final = scratch(ranked.where("not spare").unionByName(moved), "final")
    for done in (slim, drawn, tied, placed, ranked):
        drop_scratch(done)
    return gapless_rank(final, ["shard"], "draw", ["id"], "slot", total).select("id", "size", "text_crc32", "shard", F.col("slot").cast("bigint").alias("slot"), "link")


def cut_links(placed: DataFrame) -> DataFrame:
    """One row over the result of shard_documents: linked rows, and those outside the shard that holds most of their link."""
    held = placed.where("link is not null").groupBy("link", "shard").agg(F.count("*").alias("n")).groupBy("link").agg(F.sum("n").alias("rows"), F.max("n").alias("most")).where("rows > 1")
    return held.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("linked"), F.coalesce(F.sum(F.col("rows") - F.col("most")), F.lit(0)).alias("cut"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """The shard and slot of every document by law `rows`; nulls, blanks, long texts, repeats and empty tables as in
    shard_documents."""
    found = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
