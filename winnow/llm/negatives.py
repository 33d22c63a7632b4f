"""Hard-negative mining by norm-bucketed exact search over whole-number vectors.

1. `bucketed`: candidates are sorted by falling norm (by ranges, so no task sorts all of them) and cut into buckets of
   `bucket_rows` rows, each one packed row of a table with its largest norm.  Buckets are dealt over groups in turn, so that
   every group has buckets of all norms and visits the largest first.
2. Anchors are packed likewise in chunks of `chunk_rows`.  Each pair of a chunk and a group is one task: the stated query
   set against all rows, in blocks of bounded size.
3. First pass, positives: a task keeps the best rows of each anchor's label.  A bucket is skipped for every anchor whose norm
   times the bucket's largest norm (Cauchy-Schwarz) lies below the anchor's running k-th score.
4. Second pass, negatives: each anchor and positive has a window of scores.  Buckets whose bound lies below the lower limit
   of all windows of a chunk are not even sent to it; in a task a bucket is skipped for each window whose lower limit or
   running k-th score its bound does not reach.
5. What a task found is a few rows for each anchor or window; the best of all groups are taken per anchor or window.

Bounds are compared with a margin over rounding, and strictly, so ties are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from .kit import drop_scratch, map_batches, scratch, ship

#: Squared norms up to here: all products of two rows are exact in doubles.  Larger rows take no part.
MOST = float(1 << 53)
NULL_ID = (1 << 63) - 1
PACK = "hi double, keys binary, ids binary, labels binary, width int, vectors binary"


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, noise_every: int, labels: int) -> DataFrame:
    """id, label and vector (array of long) of the rows that take part, with norm2, the squared norm.

    Components become floor(scale * x); where the id is divisible by noise_every (0: never) the label moves on by one of
    `labels`.
    """
    x = F.col(vector_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    moved = F.col(label_col).cast("bigint")
    if noise_every:
        moved = F.when(F.col(id_col) % noise_every == 0, (moved + 1) % labels).otherwise(moved)
    own = rows.where(F.col(label_col).isNotNull() & x.isNotNull() & ~bad).select(F.col(id_col).cast("bigint").alias("id"), moved.alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("vector"))
    return own.withColumn("norm2", F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)).where(F.col("norm2") < MOST)


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """PACK rows with a number `pack`: `size` rows of id, label, vector, norm2 and key each, by falling norm."""
    dealt = ranked(rows, [F.col("norm2").desc(), F.col("key")], "place").withColumn("pack", F.floor(F.col("place") / size).cast("bigint"))
    ship(rows.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        vectors = t["vector"].combine_chunks()
        lengths = vectors.value_lengths().to_numpy()
        width = int(lengths.max(initial=0))
        m = np.zeros((len(lengths), width))
        m[np.arange(width) < lengths[:, None]] = vectors.flatten().to_numpy()
        order = np.argsort(t["id"].fill_null(NULL_ID).to_numpy(), kind="stable")
        column = lambda c: t[c].to_numpy()[order].astype(np.int64).tobytes()
        ids = t["id"].fill_null(NULL_ID).to_numpy()[order].tobytes()
        hi = float(np.sqrt(t["norm2"].to_numpy().max(initial=0)))
        return pa.table([pa.array(x) for x in ([t["pack"][0].as_py()], [hi], [column("key")], [ids], [column("label")])] + [pa.array([width], pa.int32()), pa.array([m[order].tobytes()])], names=["pack", "hi", "keys", "ids", "labels", "width", "vectors"])

    return dealt.select("pack", "id", "key", "label", "norm2", "vector").groupBy("pack").applyInArrow(run, f"pack bigint, {PACK}")


class Pack:
    """Rows of a packed table, one after another."""

    def __init__(self, t: pa.Table, at: int):
        row = {c: t[c][at].as_py() for c in ("hi", "keys", "ids", "labels", "width", "vectors")}
        self.hi, self.width = row["hi"], row["width"]
        self.keys, self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("keys", "ids", "labels"))
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(self.keys), self.width)

    def norms(self) -> np.ndarray:
        return np.sqrt((self.vectors * self.vectors).sum(axis=1))

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """Inner products of vectors with this bucket's rows; a shorter vector counts as filled up with zeros."""
        w = min(self.width, vectors.shape[1])
        return vectors[:, :w] @ self.vectors[:, :w].T


class Top:
    """The k best (score, id) of each of n searches, equal scores by the smaller id."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), NULL_ID, np.int64)
        self.key = np.full((n, k), -1, np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, good: np.ndarray, bucket: Pack) -> None:
        """Takes what `good` marks of scores, a line for each of the searches `rows`."""
        least, last = self.score[rows, -1][:, None], self.id[rows, -1][:, None]
        line, at = np.nonzero(good & ((scores > least) | ((scores == least) & (bucket.ids < last))))
        if not len(line):
            return
        k = self.score.shape[1]
        # of one bucket no more than the first k of a line count
        order = np.lexsort((bucket.ids[at], -scores[line, at], line))
        line, at = line[order], at[order]
        starts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        place = np.arange(len(line)) - np.repeat(starts, np.diff(np.append(starts, len(line))))
        line, at, place = line[place < k], at[place < k], place[place < k]
        hit, of = np.unique(line, return_inverse=True)
        own = rows[hit]
        score, id_, key = np.full((len(hit), 2 * k), -np.inf), np.full((len(hit), 2 * k), NULL_ID, np.int64), np.full((len(hit), 2 * k), -1, np.int64)
        score[:, :k], id_[:, :k], key[:, :k] = self.score[own], self.id[own], self.key[own]
        score[of, k + place], id_[of, k + place], key[of, k + place] = scores[line, at], bucket.ids[at], bucket.keys[at]
        best = np.lexsort((id_, -score), axis=1)[:, :k]
        self.score[own], self.id[own], self.key[own] = (np.take_along_axis(x, best, axis=1) for x in (score, id_, key))

    def table(self, **columns: np.ndarray) -> pa.Table:
        line, at = np.nonzero(self.key >= 0)
        found = {"key": self.key[line, at], "id": self.id[line, at], "score": self.score[line, at].astype(np.int64)}
        return pa.table({c: v[line] for c, v in columns.items()} | found)


def reach(norm: np.ndarray, hi: float) -> np.ndarray:
    """No inner product of vectors of these norms is above this (Cauchy-Schwarz, with a margin for rounding)."""
    return norm * hi * (1 + 1e-9) + 0.5


LINES = 256


def _positives(anchors: pa.Table, buckets: pa.Table, k: int) -> pa.Table:
    own = Pack(anchors, 0)
    norm, top = own.norms(), Top(len(own.keys), k)
    for b in np.argsort(-buckets["hi"].to_numpy(), kind="stable").tolist():
        bucket = Pack(buckets, b)
        alive = np.flatnonzero(reach(norm, bucket.hi) >= top.score[:, -1])
        for rows in (alive[i : i + LINES] for i in range(0, len(alive), LINES)):
            same = (own.labels[rows][:, None] == bucket.labels) & (own.keys[rows][:, None] != bucket.keys)
            top.add(rows, bucket.scores(own.vectors[rows]), same, bucket)
    return top.table(anchor=own.keys)


def _negatives(anchors: pa.Table, buckets: pa.Table, k: int) -> pa.Table:
    """anchors: a pack with windows (place of the anchor, positive, lowest and highest score)."""
    own = Pack(anchors, 0)
    place, number, low, high = (np.frombuffer(anchors[c][0].as_py(), np.int64) for c in ("w_place", "w_number", "w_low", "w_high"))
    norm, top = own.norms()[place], Top(len(place), k)
    for b in np.argsort(-buckets["hi"].to_numpy(), kind="stable").tolist():
        bucket = Pack(buckets, b)
        alive = np.flatnonzero(reach(norm, bucket.hi) >= np.maximum(low, top.score[:, -1]))
        for rows in (alive[i : i + LINES] for i in range(0, len(alive), LINES)):
            of, line = np.unique(place[rows], return_inverse=True)
            scores = bucket.scores(own.vectors[of])[line]
            good = (own.labels[place[rows]][:, None] != bucket.labels) & (scores >= low[rows][:, None]) & (scores <= high[rows][:, None])
            top.add(rows, scores, good, bucket)
    return top.table(anchor=own.keys[place], number=number)


def _against(chunks: DataFrame, buckets: DataFrame, groups: int, search, k: int, schema: str) -> DataFrame:
    """search over each chunk (rows with column `chunk`) and the buckets (with `group` and `chunk`) sent to it, a task for
    each chunk and group."""
    sent = chunks.withColumn("group", F.explode(F.expr(f"sequence(0L, {groups - 1}L)")))
    empty = pa.schema([("anchor", pa.int64())] + ([("number", pa.int64())] if "number" in schema else []) + [("key", pa.int64()), ("id", pa.int64()), ("score", pa.int64())]).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return search(left, right, k) if left.num_rows and right.num_rows else empty

    return sent.groupBy("chunk", "group").cogroup(buckets.groupBy("chunk", "group")).applyInArrow(run, schema)


def mine(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor_every: int = 50, noise_every: int = 7, labels: int = 10, scale: int = 256,
    positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, bucket_rows: int = 1024, group_rows: int = 65536, chunk_rows: int = 8192,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors (ids divisible by anchor_every).

    Positives are an anchor's first other rows of its label by score; negatives the first rows of another label whose score
    times 100 lies from `least` to `most` times the positive's.  Higher scores come first, ties by smaller id, a null id
    last.  Rows with a null label or vector, or a null or non-finite component, take no part, nor do those whose squared
    norm (after scaling) reaches 2**53.  A shorter vector counts as filled up with zeros, so one without components
    is the zero vector.  Repeated rows, and rows that share an id, are rows of their own: each can be an anchor,
    and each other's positive.  An anchor without positives or negatives gives no row; an empty table none.
    Columns other than the three named play no part.
    """
    taken = scratch(whole_vectors(rows, id_col, vector_col, label_col, scale, noise_every, labels), "vectors").withColumn("key", F.monotonically_increasing_id())
    numbered = scratch(taken, "numbered")  # a key that later passes read as it was
    buckets = scratch(_pack(numbered, bucket_rows), "buckets")
    anchors = scratch(_pack(numbered.where(F.col("id") % anchor_every == 0), chunk_rows).withColumnRenamed("pack", "chunk"), "anchors")
    for done in (taken, numbered):
        drop_scratch(done)
    many, chunks = buckets.count(), anchors.count()
    groups = max(1, min(many, max(-(-many * bucket_rows // group_rows), rows.sparkSession.sparkContext.defaultParallelism)))
    dealt = buckets.withColumn("group", F.col("pack") % groups)
    every = dealt.withColumn("chunk", F.explode(F.expr(f"sequence(0L, {max(chunks, 1) - 1}L)")))
    order = [F.col("score").desc(), F.col("id"), F.col("key")]

    found = _against(anchors, every, groups, _positives, positives, "anchor bigint, key bigint, id bigint, score bigint")
    first = found.withColumn("number", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("number") <= positives)
    windows = scratch(
        first.select("anchor", "id", "score", F.col("number").cast("bigint").alias("number"), F.expr(f"({least} * score + 99) div 100").alias("low"), F.expr(f"({most} * score) div 100").alias("high")).where("score >= 0"), "windows"
    )

    armed = scratch(_armed(anchors, windows, chunk_rows), "armed")
    # buckets that reach some window of the chunk: the chunk's least lower limit for a unit of the anchor's norm
    sent = every.join(armed.select("chunk", "need"), "chunk").where(F.col("hi") * (1 + 1e-9) + 1e-6 >= F.col("need")).drop("need")
    found = _against(armed.drop("need"), sent, groups, _negatives, negatives, "anchor bigint, number bigint, key bigint, id bigint, score bigint")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "number").orderBy(*order))).where(F.col("rank") <= negatives)
    best = best.select("anchor", "number", "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score"))
    real = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    out = scratch(
        best.join(windows, ["anchor", "number"]).select("anchor", real("id").alias("positive_id"), "rank", real("negative").alias("negative_id"), F.col("score").alias("positive_score"), "negative_score"), "negatives"
    )
    names = _names(anchors)
    return out.join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _names(anchors: DataFrame) -> DataFrame:
    """(anchor, anchor_id) of the rows of packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, ids in zip(batch.column(0), batch.column(1)):
                yield pa.record_batch([pa.array(np.frombuffer(x.as_py(), np.int64)) for x in (keys, ids)], names=["anchor", "anchor_id"])

    return map_batches(anchors.select("keys", "ids"), run, "anchor bigint, anchor_id bigint")


def _armed(anchors: DataFrame, windows: DataFrame, chunk_rows: int) -> DataFrame:
    """The packs of anchors with the windows of their rows and `need`, the norm a bucket must have for any of them; packs
    without windows go."""
    of = map_batches(anchors.select("chunk", "keys"), _places, "chunk bigint, anchor bigint, place bigint")
    own = of.join(windows.select("anchor", "number", "low", "high"), "anchor").select("chunk", "place", "number", "low", "high")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        pack = Pack(left, 0)
        right = right.sort_by([("place", "ascending"), ("number", "ascending")])
        place, low = right["place"].to_numpy(), right["low"].to_numpy()
        norm = pack.norms()[place]
        need = float(np.min((low - 0.5) / np.maximum(norm, 1e-300)))
        out = left.select(["chunk", "hi", "keys", "ids", "labels", "width", "vectors"])
        for name, c in (("w_place", "place"), ("w_number", "number"), ("w_low", "low"), ("w_high", "high")):
            out = out.append_column(name, pa.array([right[c].to_numpy().astype(np.int64).tobytes()]))
        return out.append_column("need", pa.array([need]))

    kinds = {"bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "int": pa.int32()}
    schema = f"chunk bigint, {PACK}, w_place binary, w_number binary, w_low binary, w_high binary, need double"
    empty = pa.schema([(c, kinds[t]) for c, t in (x.split() for x in schema.split(", "))]).empty_table()
    return anchors.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(run, schema)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, keys in zip(batch.column(0), batch.column(1)):
            own = np.frombuffer(keys.as_py(), np.int64)
            yield pa.record_batch([pa.array(np.full(len(own), chunk.as_py(), np.int64)), pa.array(own), pa.array(np.arange(len(own)))], names=["chunk", "anchor", "place"])


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive; nulls, ties, repeats, odd vectors and empty tables as in mine."""
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


ORACLE_SQL = {
    "op13_hard_negatives": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT a, anchor_id, b AS p, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST, b) <= 5),
n AS (SELECT p.a, anchor_id, p, positive_id, positive_score, id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p ORDER BY score DESC, id NULLS LAST)::INT AS rank
  FROM p JOIN (SELECT a, id, score FROM s WHERE NOT same) s ON s.a = p.a AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""",
}
