"""Stupid-backoff language-model scores as partitioned count tables joined to exploded n-grams.

1. Documents are packed into segments of a few MB.  A segment explodes its texts into n-grams and asks for the counts of
   the distinct ones (64-bit hashes, sorted).
2. The count table of an order is partitioned by hash: hash range b of every segment goes to bucket b, where counts are
   summed over segments and each segment gets the totals of its own n-grams back, in its own order.
3. Orders are counted level by level: words and pairs at once; from then on an n-gram is asked for only if both
   (n-1)-grams in it reach the cutoff, for only then can it reach it.  This is exact, and most n-grams never move.
4. Segments are joined with their totals; scores follow per word by backoff and are summed per document, in whole
   numbers, so a document's score does not depend on its neighbours.

Rows of the joins are packed arrays rather than single n-grams: an n-gram travels once per segment however often it
occurs, so very common ones cost no more than others, and buckets are even because hashes are.  The number of
buckets follows the size of the corpus, so a bucket's arrays stay within a worker's memory; a row for each
segment and bucket that have n-grams in common, so there are never more rows than distinct n-grams of segments.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import Spans, chain, exact_sums, map_batches, per_doc_sum, release, scratch, ship, slices, squeeze, text_bytes, unsqueeze, words_of

SEGMENT_BYTES = 8 << 20
HASH_BYTES = 1 << 19
BUCKET_BYTES = 32 << 20
ALPHA = 0.4
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEEDS = [np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x2545F4914F6CDD1D)]


def unpacked(text: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8)


def grams(b: np.ndarray, off: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(for each k in 1..order, hashes of the k-grams that end at each word, first word of each document).

    Where a document has fewer than k words up to there, the entry is 0.
    """
    parts, counts = [], []
    for i, j in slices(off, HASH_BYTES):  # a word's hash does not depend on its place
        x = LOWER[b[off[i] : off[j]]]
        starts, ends, at = words_of(x, off[i : j + 1] - off[i])
        parts.append(Spans(x).hashes(starts, ends))
        counts.append(np.diff(at))
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    first = np.concatenate(([0], np.cumsum(np.concatenate(counts)))) if counts else np.zeros(1, np.int64)
    place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    out = []
    for k in range(1, order + 1):
        x = np.zeros(len(h), dtype=np.uint64)
        if len(h) >= k:
            x[k - 1 :] = chain(h[: len(h) - k + 1] ^ SEEDS[k - 1], *[h[j : len(h) - k + 1 + j] for j in range(1, k)])
            x[x == 0] = 1
            x[place < k - 1] = 0
        out.append(x)
    return out, first


def segments_of(docs: DataFrame, id_col: str, text_col: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            nonlocal number
            ids = pa.concat_arrays([x for x, _, _ in held])
            text = np.concatenate([x for _, x, _ in held])
            sizes = np.concatenate([x for _, _, x in held])
            held.clear()
            off = np.concatenate(([0], np.cumsum(sizes)))
            number += 1
            n_words = len(words_of(text, off)[0])
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([n_words], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([len(text)], pa.int64()), pa.array([squeeze(off)]), pa.array([zstandard.ZstdCompressor(level=3).compress(text.tobytes())])], names=["seg", "words", "ids", "bytes", "off", "text"])

        size = 0
        for batch in batches:
            b, off = text_bytes(batch.column(1))
            for i, j in slices(off, segment_bytes):
                held.append((batch.column(0).slice(i, j - i), b[off[i] : off[j]].copy(), np.diff(off[i : j + 1])))
                size += int(off[j] - off[i])
                if size >= segment_bytes // 2:
                    yield out()
                    size = 0
        if held:
            yield out()

    return scratch(map_batches(slim, run, "seg bigint, words bigint, ids array<bigint>, bytes bigint, off binary, text binary"), "segments")


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys but 0, how often each occurs)."""
    keys = np.sort(keys)
    keys = keys[np.searchsorted(keys, 1) :]
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
    return keys[cut[:-1]], np.diff(cut)


def _asked(seg: int | None, keys: np.ndarray, n: np.ndarray, bits: int, counted: bool) -> Iterator[tuple]:
    """Rows (bucket, seg, keys, counts) for sorted distinct keys."""
    edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.int64)
    bounds = np.concatenate(([0], edges, [len(keys)])).tolist()
    for k, (x, y) in enumerate(zip(bounds, bounds[1:])):
        if y > x:
            yield k, seg, squeeze(np.diff(keys[x:y], prepend=np.uint64(0))), squeeze(n[x:y]) if counted else None


def _request_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    kinds = [("bucket", pa.int64()), ("seg", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]
    return pa.table({name: pa.array(c, kind) for c, (name, kind) in zip(cols, kinds)})


REQUEST = "bucket bigint, seg bigint, keys binary, counts binary"


def _texts(off: bytes, text: bytes, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    return grams(unpacked(text), unsqueeze(off).astype(np.int64), order)


def _first_requests(segments: DataFrame, bits: int, counted: bool, answered: bool) -> DataFrame:
    """What segments ask for words and pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, off, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                keys, n = _distinct(np.concatenate(_texts(off.as_py(), text.as_py(), 2)[0]))
                for row in _asked(seg if answered else None, keys, n, bits, counted):
                    yield from _request_table([row]).to_batches()

    return map_batches(segments.select("seg", "off", "text"), run, REQUEST)


def _totals(group: pa.Table) -> pa.Table:
    """The totals of one bucket, for each segment that asks."""
    rows = sorted(zip(group["seg"].to_pylist(), group["bucket"].to_pylist(), group["keys"].to_pylist(), group["counts"].to_pylist()), key=lambda r: (r[0] is None, r[0] or 0))
    keys = [np.cumsum(unsqueeze(r[2]), dtype=np.uint64) for r in rows]
    counts = [unsqueeze(r[3]) if r[3] is not None else np.zeros(len(k), np.uint64) for k, r in zip(keys, rows)]
    table, back = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(back, weights=np.concatenate(counts).astype(np.float64), minlength=len(table)).astype(np.uint64)
    out, at = [], 0
    for k, r in zip(keys, rows):
        if r[0] is not None:
            out.append((r[0], r[1], squeeze(sums[back[at : at + len(k)]])))
        at += len(k)
    cols = list(zip(*out)) if out else [[], [], []]
    return pa.table({"seg": pa.array(cols[0], pa.int64()), "bucket": pa.array(cols[1], pa.int64()), "totals": pa.array(cols[2], pa.binary())})


def _counted(asked: DataFrame, level: int) -> DataFrame:
    """(seg, level, bucket, totals) for requests of one level, written and read again."""
    found = asked.groupBy("bucket").applyInArrow(_totals, "seg bigint, bucket bigint, totals binary")
    return scratch(found.select("seg", F.lit(level).cast("bigint").alias("level"), "bucket", "totals"), "totals")


class _Known:
    """The counts of a segment's n-grams, from the answers so far."""

    def __init__(self, answers: pa.Table):
        self.parts: dict[int, list[tuple[int, bytes]]] = {}
        for level, bucket, totals in zip(answers["level"].to_pylist(), answers["bucket"].to_pylist(), answers["totals"].to_pylist()):
            self.parts.setdefault(level, []).append((bucket, totals))

    def _spread(self, level: int, asked: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Counts of wanted, given the distinct keys `asked` at that level; 0 for others."""
        known = np.concatenate([np.zeros(0, np.uint64), *[unsqueeze(x) for _, x in sorted(self.parts.get(level, []))]])
        if not len(asked):
            return np.zeros(len(wanted), dtype=np.int64)
        at = np.minimum(np.searchsorted(asked, wanted), len(asked) - 1)
        return np.where(asked[at] == wanted, known[at], 0).astype(np.int64)

    def counts(self, found: list[np.ndarray], order: int, cutoff: int) -> list[np.ndarray]:
        """Of each order up to `order`, the count of the gram that ends at each word (0 where it was not asked for)."""
        asked = _distinct(np.concatenate(found[:2]))[0]
        out = [self._spread(2, asked, x) for x in found[:2]]
        for k in range(3, order + 1):
            may = hopeful(found[k - 1], out[k - 2], cutoff)
            out.append(np.where(may, self._spread(k, _distinct(found[k - 1][may])[0], found[k - 1]), 0))
        return out


def hopeful(grams_here: np.ndarray, shorter: np.ndarray, cutoff: int) -> np.ndarray:
    """Where an n-gram can reach the cutoff: both (n-1)-grams in it do."""
    reach = shorter >= cutoff
    return (grams_here != 0) & reach & np.concatenate(([False], reach[:-1]))


def stupid_backoff(docs: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", order: int = 3, alpha: float = ALPHA, cutoff: int = 2, segment_bytes: int = SEGMENT_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of docs: id, n_words, log_score, and n_by_order (words scored by each order, from 1).

    Words are runs without ASCII white space, A-Z lower-cased; n-grams stay within a document.  A word scores
    c(gram)/c(context) by the longest gram ending there with c >= cutoff, times alpha for each order it fell back; the
    unigram scores max(c, 1/2)/N.  Counts are over all of corpus (default: docs itself).  A null, empty or blank text has no
    words and score 0; texts of any length count whole; ids may repeat or be null, and repeated rows all stay (and
    count); other columns, whatever their names, are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    own = segments_of(docs, id_col, text_col, segment_bytes)
    base = own if corpus is None else segments_of(corpus, id_col, text_col, segment_bytes)
    total, size = base.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    bits = max(3, math.ceil(math.log2(max(1, size / bucket_bytes))))
    logs = math.log(alpha)

    def ask(level: int, counted: bool, answered: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = []
            for seg, off, text in zip(left["seg"].to_pylist(), left["off"].to_pylist(), left["text"].to_pylist()):
                found = _texts(off, text, level)[0]
                counts = _Known(right).counts(found[: level - 1], level - 1, cutoff)
                keys, n = _distinct(found[level - 1][hopeful(found[level - 1], counts[-1], cutoff)])
                rows += _asked(seg if answered else None, keys, n, bits, counted)
            return _request_table(rows)

        return run

    #: (segments, whether their n-grams count, whether they need the totals of the last level)
    sides = [(own, True, True)]
    if corpus is not None:  # the corpus asks too, to know which of its longer n-grams to count
        own = own.withColumn("seg", -F.col("seg"))
        sides = [(own, False, True), (base, True, False)]
    asked = None
    for segments, counted, needed in sides:
        one = _first_requests(segments, bits, counted, needed or order > 2)
        asked = one if asked is None else asked.unionByName(one)
    answers = _counted(asked, 2)
    for level in range(3, order + 1):
        asked = one = None  # what they were shuffled by can go
        release(spark)
        for segments, counted, needed in sides:
            one = segments.select("seg", "off", "text").groupBy("seg").cogroup(answers.groupBy("seg")).applyInArrow(ask(level, counted, needed or level < order), REQUEST)
            asked = one if asked is None else asked.unionByName(one)
        answers = answers.unionByName(_counted(asked, level))
    asked = one = None
    release(spark)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, n_words, scores, orders = [], [], [], []
        for row_ids, off, text in zip(left["ids"].to_pylist(), left["off"].to_pylist(), left["text"].to_pylist()):
            found, first = _texts(off, text, order)
            counts = _Known(right).counts(found, order, cutoff)
            value = np.log(np.maximum(counts[0], 0.5) / max(total, 1))
            level = np.ones(len(value), dtype=np.int64)
            for k in range(1, order):
                context = np.concatenate(([0], counts[k - 1][:-1]))
                seen = (counts[k] >= cutoff) & (context > 0)
                lower = value + np.where(found[k] != 0, logs, 0.0)
                value = np.where(seen, np.log(np.where(seen, counts[k], 1) / np.where(seen, context, 1)), lower)
                level[seen] = k + 1
            ids += row_ids
            n_words.append(np.diff(first))
            scores.append(exact_sums(value, first))
            orders.append(np.stack([per_doc_sum((level == k).astype(np.int64), first) for k in range(1, order + 1)], axis=1))
        none = np.zeros(0)
        return pa.table({"id": pa.array(ids, pa.int64()), "n_words": pa.array(np.concatenate([none, *n_words]), pa.int64()), "log_score": pa.array(np.concatenate([none, *scores]), pa.float64()), "n_by_order": pa.array(np.concatenate(orders).tolist() if orders else [], pa.list_(pa.int64()))})

    return own.select("seg", "ids", "off", "text").groupBy("seg").cogroup(answers.groupBy("seg")).applyInArrow(score, "id bigint, n_words bigint, log_score double, n_by_order array<bigint>")


def op1_lm_scores(spark, sf_dir: str) -> DataFrame:
    """The score of every document against counts over all of them; nulls, blanks, long texts, repeats and empty tables as
    stupid_backoff says."""
    found = stupid_backoff(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.round("log_score", 4).alias("log_score"),
        F.element_at("n_by_order", 3).alias("n_trigram"), F.element_at("n_by_order", 2).alias("n_bigram"), F.element_at("n_by_order", 1).alias("n_unigram"),
    )


ORACLE_SQL = {
    "op1_lm_scores": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
t AS (SELECT r, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
u1 AS (SELECT c, count(*) AS n FROM t GROUP BY c),
u2 AS (SELECT b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY b, c),
u3 AS (SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY a, b, c),
s AS (SELECT count(*) AS n FROM t),
x AS (SELECT t.r, t.a, t.b, k3.n AS n3, k2c.n AS n2c, k2.n AS n2, k1c.n AS n1c, k1.n AS n1, s.n AS n
  FROM t, s JOIN u1 k1 ON t.c = k1.c LEFT JOIN u2 k2 ON t.b = k2.b AND t.c = k2.c LEFT JOIN u1 k1c ON t.b = k1c.c
  LEFT JOIN u3 k3 ON t.a = k3.a AND t.b = k3.b AND t.c = k3.c LEFT JOIN u2 k2c ON t.a = k2c.b AND t.b = k2c.c),
y AS (SELECT r, CASE WHEN n3 >= 2 THEN 3 WHEN n2 >= 2 THEN 2 ELSE 1 END AS o,
  CASE WHEN n3 >= 2 THEN ln(n3 / n2c)
    WHEN n2 >= 2 THEN ln(n2 / n1c) + CASE WHEN a IS NOT NULL THEN ln(0.4) ELSE 0 END
    ELSE ln(n1 / n) + CASE WHEN a IS NOT NULL THEN 2 * ln(0.4) WHEN b IS NOT NULL THEN ln(0.4) ELSE 0 END END AS v FROM x),
z AS (SELECT r, sum(v) AS v, count(*) FILTER (o = 3) AS o3, count(*) FILTER (o = 2) AS o2, count(*) FILTER (o = 1) AS o1 FROM y GROUP BY r)
SELECT doc_id, len(w) AS n_words, round(coalesce(v, 0.0), 4) AS log_score, coalesce(o3, 0) AS n_trigram, coalesce(o2, 0) AS n_bigram, coalesce(o1, 0) AS n_unigram
FROM d LEFT JOIN z USING (r)
""",
}
