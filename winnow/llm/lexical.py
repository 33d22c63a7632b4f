"""Ranked lexical search by Fagin's threshold algorithm over an impact-sorted index.

1. `build_index`: one pass counts documents and terms (N and L), then texts are dealt in segments of a few MB.  The row of a
   segment holds, for each of its distinct terms, the list of its documents sorted by falling impact (what the term adds
   to a document's score but for the term's weight), and a forward index: each document's terms with their impacts.
   Segments lie in the shared folder, dealt by document; postings never move.
2. `search`: items are taken in blocks of at most `block_bytes` of text.  The index first gives the number of documents that
   hold each of a block's terms, hence the weights.  Then each task runs the threshold algorithm over its segments: rounds
   read the lists of an item's terms side by side, `step` entries deep at a time; each document met for the first time is
   scored whole by lookups in the forward index; the threshold is the sum of the impacts just reached.  It stops
   when the threshold falls strictly below the k-th score found so far by that task, so that no tie is lost.
3. What leaves a task is k rows an item; two rounds of top-k give the ranks.

All sums are whole numbers, so no order of documents, segments or tasks changes a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .decontaminate import ANY_WORD, term_hashes
from .kit import drop_scratch, map_batches, scratch, slices, squeeze, text_bytes, unsqueeze

SEGMENT_BYTES = 4 << 20
INDEX = "seg bigint, ids binary, known binary, terms binary, sizes binary, docs binary, impacts binary, forward binary"


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents with a term, terms of all documents)."""
    n = F.regexp_count(F.col(text_col).cast("string"), F.lit(ANY_WORD)).cast("bigint")
    row = docs.select(n.alias("n")).where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return row[0], row[1]


def impact(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What a term that occurs tf times in a document of n terms adds to its score, but for the term's weight."""
    tf, n = tf.astype(np.int64), n.astype(np.int64)
    m = 100 - 90 + (90 * n * docs) // max(terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def build_index(docs: DataFrame, size: tuple[int, int], id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of all texts of docs, written to the shared folder: a row for each segment of at most about segment_bytes (a
    longer text is a segment of its own).  size: what corpus_size says.  Null texts and texts without terms are in no
    list; repeated rows are documents of their own; a null id is kept."""
    n_docs, n_terms = size
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, known = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            b, off = text_bytes(batch.column(1))
            for i, j in slices(off, segment_bytes):
                h, first = term_hashes(b[off[i] : off[j]], off[i : j + 1] - off[i])
                n = np.diff(first)
                terms, term = np.unique(h, return_inverse=True)
                doc = np.repeat(np.arange(j - i), n)
                pairs, tf = np.unique(doc * np.int64(len(terms) or 1) + term, return_counts=True)  # by document, then term
                of, at = pairs // (len(terms) or 1), pairs % (len(terms) or 1)
                gain = impact(tf, n[of], n_docs, n_terms)
                order = np.lexsort((of, -gain, at))  # each term's documents by falling impact
                seg += 1
                row = [
                    squeeze(ids[i:j].view(np.uint64)), np.packbits(known[i:j]).tobytes(), squeeze(np.diff(terms, prepend=np.uint64(0))), squeeze(np.bincount(at, minlength=len(terms)).astype(np.uint32)),
                    squeeze(of[order].astype(np.uint32)), squeeze(gain[order].astype(np.uint32)), squeeze(order.astype(np.uint32)),
                ]
                yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int64()), *[pa.array([x], pa.binary()) for x in row]], names=["seg", "ids", "known", "terms", "sizes", "docs", "impacts", "forward"])

    return scratch(map_batches(slim, run, INDEX), "lexical")


class Segment:
    """A segment of the index: lists by term, and the same postings by document."""

    def __init__(self, ids: bytes, known: bytes, terms: bytes, sizes: bytes, docs: bytes, impacts: bytes, forward: bytes):
        self.ids = unsqueeze(ids).view(np.int64)
        self.known = np.unpackbits(np.frombuffer(known, np.uint8), count=len(self.ids)).astype(bool)
        self.terms = np.cumsum(unsqueeze(terms), dtype=np.uint64)
        self.first = np.concatenate(([0], np.cumsum(unsqueeze(sizes).astype(np.int64))))
        self.docs = unsqueeze(docs).astype(np.int64)
        self.impacts = unsqueeze(impacts).astype(np.int64)
        order = unsqueeze(forward).astype(np.int64)
        self.width = max(1, len(self.terms))
        self.keys = np.empty(len(order), np.int64)  # document and term, rising
        self.keys[order] = self.docs * self.width + np.repeat(np.arange(len(self.terms)), np.diff(self.first))
        self.gains = np.empty(len(order), np.int64)
        self.gains[order] = self.impacts

    def lookup(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """The impacts of terms in documents, a row for each document; 0 where a document has not got the term."""
        want = docs[:, None] * self.width + terms
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.gains[at], 0)


class Items:
    """The terms of a block's items over a sorted vocabulary of hashes, each once an item."""

    def __init__(self, ids: list[str | None], texts: list[str | None]):
        b, off = text_bytes(pa.array(texts, pa.large_string()))
        h, first = term_hashes(b, off)
        self.vocabulary, term = np.unique(h, return_inverse=True)
        self.ids = list(dict.fromkeys(ids))
        rows: dict = {x: [] for x in self.ids}
        for k, x in enumerate(ids):
            rows[x].append(term[first[k] : first[k + 1]])
        self.terms = [np.unique(np.concatenate(rows[x])) for x in self.ids]
        self.weights = np.zeros(len(self.vocabulary), np.int64)

    def weigh(self, held: np.ndarray, docs: int) -> None:
        """Weights from the number of documents that hold each term."""
        self.weights = np.floor(1000 * np.log((2.0 * docs + 2) / (2.0 * held + 1))).astype(np.int64) * (held > 0)


def documents_with(index: DataFrame, items: Items) -> np.ndarray:
    """In how many documents of the index each term of the block is."""
    shared = index.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(len(own), np.int64)
        for batch in batches:
            for terms, sizes in zip(batch.column(0), batch.column(1)):
                has, n = np.cumsum(unsqueeze(terms.as_py()), dtype=np.uint64), unsqueeze(sizes.as_py())
                if len(has) and len(own):
                    at = np.minimum(np.searchsorted(has, own), len(has) - 1)
                    total += np.where(has[at] == own, n[at], 0).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(len(items.vocabulary), np.int64)
    found = map_batches(index.select("terms", "sizes"), run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the block at most
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    shared.destroy()
    return out


class Best:
    """The k best (score, id) seen by a task for an item; ties go to the smaller id, a null id comes last."""

    def __init__(self, k: int):
        self.k = k
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.known = np.zeros(0, bool)

    @property
    def least(self) -> int:
        """The k-th score, 0 while there are fewer."""
        return int(self.score[self.k - 1]) if len(self.score) >= self.k else 0

    def add(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        good = score > 0 if self.least == 0 else score >= self.least
        if good.any():
            score, ids, known = (np.concatenate(x) for x in ((self.score, score[good]), (self.id, ids[good]), (self.known, known[good])))
            order = np.lexsort((ids, ~known, -score))[: self.k]
            self.score, self.id, self.known = score[order], ids[order], known[order]


def threshold_search(segment: Segment, terms: np.ndarray, weights: np.ndarray, best: Best, step: int = 8) -> int:
    """Fagin's threshold algorithm over the lists of `terms` in one segment, into best; returns the entries read of each list."""
    lo, hi = segment.first[terms], segment.first[terms + 1]
    met = np.zeros(len(segment.ids), dtype=bool)
    depth, longest = 0, int((hi - lo).max(initial=0))
    while depth < longest:
        past = min(longest, depth + step)
        cells = lo[:, None] + np.arange(depth, past)
        docs = np.unique(segment.docs[cells[cells < hi[:, None]]])
        docs = docs[~met[docs]]
        if len(docs):
            met[docs] = True
            best.add(segment.lookup(docs, terms) @ weights, segment.ids[docs], segment.known[docs])
        # a document not met yet has at most the impacts just reached; lists that ended hold none
        reached = np.where(lo + past < hi, segment.impacts[np.minimum(lo + past - 1, hi - 1)], 0)
        depth = past
        if int(reached @ weights) < best.least:
            break
        step *= 2
    return depth


def _search_block(index: DataFrame, items: Items, n_docs: int, k: int, step: int) -> DataFrame:
    items.weigh(documents_with(index, items), n_docs)
    shared = index.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best = [Best(k) for _ in own.ids]
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment(*(batch.column(c)[row].as_py() for c in range(batch.num_columns)))
                if not len(segment.terms):
                    continue
                at = np.minimum(np.searchsorted(segment.terms, own.vocabulary), len(segment.terms) - 1)
                here = (segment.terms[at] == own.vocabulary) & (own.weights > 0)
                for terms, found in zip(own.terms, best):
                    t = terms[here[terms]]
                    if len(t):
                        threshold_search(segment, at[t], own.weights[t], found, step)
        number = np.repeat(np.arange(len(best)), [len(x.score) for x in best])
        if len(number):
            ids = pa.array(np.concatenate([x.id for x in best]), mask=~np.concatenate([x.known for x in best]))
            yield pa.record_batch([pa.array([own.ids[i] for i in number.tolist()], pa.string()), ids, pa.array(np.concatenate([x.score for x in best]))], names=["item", "id", "score"])

    out = scratch(map_batches(index.drop("seg"), run, "item string, id bigint, score bigint").withColumn("task", F.spark_partition_id()), "ranked")
    shared.destroy()
    return out


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 10, step: int = 8, block_bytes: int = 4 << 20) -> DataFrame:
    """(item, rank, id, score): the k documents of highest score above 0 for each item, ranks from 1.

    Equal scores go by rising id, a null id last; rows of docs with the same id are documents of their own and may take
    several ranks.  Rows of items with the same id are one item with the terms of all; a null item id is an item.
    Null, empty and blank texts have no terms and no ranks; texts of any length take part whole; an empty table on
    either side gives no rows.  Other columns play no part.
    """
    size = corpus_size(docs, text_col)
    index = build_index(docs, size, id_col, text_col)
    own = scratch(items.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null").distinct(), "items")
    blocks = max(1, -(-own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // block_bytes))
    found = []
    for n in range(blocks):
        rows = own.where(F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(blocks)) == n).collect()  # about block_bytes of text
        if rows or not n:
            found.append(_search_block(index, Items([r.id for r in rows], [r.text for r in rows]), size[0], k, step))
    drop_scratch(index)
    drop_scratch(own)
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    some = every.withColumn("part", F.pmod(F.col("task"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).select("item", "rank", "id", "score")


def op12_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item; nulls, blanks, ties, long texts, repeats and empty tables as in search."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = search(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), items)
    return found.select(F.col("item").cast(items.schema["item_id"].dataType).alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = {
    "op12_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(t))::BIGINT AS terms FROM d WHERE len(t) > 0),
p AS (SELECT r, x, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS x FROM d) GROUP BY r, x),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS x FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT x, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM p, s WHERE x IN (SELECT x FROM q) GROUP BY x, docs),
m AS (SELECT r, doc_id, 10 + (90 * len(t)::BIGINT * docs) // terms AS m FROM d, s WHERE len(t) > 0),
g AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (x) JOIN p USING (x) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INT AS rank, doc_id, score FROM g WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
""",
}
