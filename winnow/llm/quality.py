"""Quality rules: counting rules on whole texts, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over 2^16 buckets of hashed n-grams (runs of `GRAM` bytes of the UTF-8 text):
one of trusted texts, one of the raw corpus.  The raw counts cover every text.  The trusted counts are fitted on at
most `sample` documents labelled good and not toxic, taken by smallest hash of their id (a documented, bounded
sample), and smoothed towards the raw multinomial.  A document's score is the sum over its n-grams divided by
their number; it is kept if the score is at least `threshold`, a constant, the same for every document and at every
size: no draw decides.  On held-out labels clean documents score -0.25 or more and rejected ones -0.85 or less where a
thousand trusted documents are known, and clean ones -0.54 or more with a hundred.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import SPACES, Spans, chain, map_batches, per_doc_sum, scramble, slices, text_bytes, words_of

BUCKETS = 1 << 16
CHUNK = 1 << 12
GRAM = 4
#: Log ratios are summed in units of 2**-SCALE.
SCALE = 32
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def gram_buckets(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, first n-gram of each document); n-grams do not cross documents."""
    n = max(len(b) - GRAM + 1, 0)
    key = np.zeros(n, dtype=np.uint32)
    for k in range(GRAM):
        key = key << np.uint32(8) | b[k : k + n]
    with np.errstate(over="ignore"):
        bucket = ((key ^ key >> np.uint32(15)) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    counts = np.maximum(np.diff(off) - GRAM + 1, 0)
    inside = np.zeros(n + 1, dtype=np.int32)
    full = counts > 0
    np.add.at(inside, off[:-1][full], 1)
    np.add.at(inside, (off[:-1] + counts)[full], -1)
    return bucket[np.cumsum(inside[:-1]) > 0], np.concatenate(([0], np.cumsum(counts)))


def _twice(keys: np.ndarray) -> np.ndarray:
    """A mask of the keys that occur at least twice."""
    cell = (keys >> np.uint64(45)).astype(np.int64)
    may = np.flatnonzero(np.bincount(cell, minlength=1 << 19)[cell] > 1)
    out = np.zeros(len(keys), dtype=bool)
    if len(may):
        _, back, n = np.unique(keys[may], return_inverse=True, return_counts=True)
        out[may] = n[back] > 1
    return out


def text_stats(b: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The columns of STATS for each document of a slice."""
    docs = len(off) - 1
    starts, ends, first = words_of(b, off)
    n_words = np.diff(first)
    spans = Spans(b)
    chars = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[b])))
    word_chars = per_doc_sum(chars[ends] - chars[starts], first)

    cut = np.unique(np.concatenate((off[:-1], np.flatnonzero(b == 0x0A) + 1)))
    cut = cut[cut < len(b)]
    line_end = np.append(cut[1:], len(b))
    line_end = np.where((line_end > cut) & (b[np.maximum(line_end, 1) - 1] == 0x0A), line_end - 1, line_end) if len(cut) else line_end
    doc = np.searchsorted(off, cut, side="right") - 1
    full = np.searchsorted(starts, line_end) > np.searchsorted(starts, cut)
    cut, line_end, doc = cut[full], line_end[full], doc[full]
    with np.errstate(over="ignore"):
        keys = scramble(spans.hashes(cut, line_end) + doc.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    _, kept = np.unique(keys, return_index=True)
    n_dup = np.bincount(doc, minlength=docs) - np.bincount(doc[kept], minlength=docs)

    h = spans.hashes(starts, ends)
    word_doc = np.repeat(np.arange(docs), n_words)
    at = np.flatnonzero(word_doc[2:] == word_doc[:-2]) if len(h) > 2 else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        windows = scramble(chain(h[at], h[at + 1], h[at + 2]) + word_doc[at].astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)) if len(at) else np.zeros(0, np.uint64)
    hit = np.zeros(len(h) + 3, dtype=bool)
    at = at[_twice(windows)]
    for k in range(3):
        hit[at + k] = True
    return [n_words, word_chars, symbols[off[1:]] - symbols[off[:-1]], n_dup, per_doc_sum(hit[: len(h)], first)]


def _summed(df: DataFrame, keys: list[str]) -> DataFrame:
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = {c: sum(np.frombuffer(x, dtype=np.int64) for x in pdf[c]).tobytes() for c in ("raw", "good")}
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "salt": [0], **{c: [v] for c, v in total.items()}})

    return df.groupBy(*keys).applyInPandas(add, "chunk bigint, salt bigint, raw binary, good binary")


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log p_trusted(bucket) / p_raw(bucket).  trusted: at most a bounded number of distinct ids, column `id`."""
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(trusted.withColumn("good", F.lit(True))), "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            b, off = text_bytes(batch.column(0))
            is_good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in slices(off):
                bucket, first = gram_buckets(b[off[i] : off[j]], off[i : j + 1] - off[i])
                raw += np.bincount(bucket, minlength=BUCKETS)
                if is_good[i:j].any():
                    good += np.bincount(bucket[np.repeat(is_good[i:j], np.diff(first))], minlength=BUCKETS)
        salt = TaskContext.get().partitionId() % 61
        parts = range(0, BUCKETS, CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array([k // CHUNK for k in parts], pa.int64()), pa.array([salt] * len(parts), pa.int64()), pa.array([raw[k : k + CHUNK].tobytes() for k in parts]), pa.array([good[k : k + CHUNK].tobytes() for k in parts])], names=["chunk", "salt", "raw", "good"])

    parts = map_batches(marked, run, "chunk bigint, salt bigint, raw binary, good binary")
    rows = _summed(_summed(parts, ["chunk", "salt"]), ["chunk"]).collect()  # 16 rows of 64 KB
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.raw, dtype=np.int64)
        good[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.good, dtype=np.int64)
    p = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    return np.log((good + BUCKETS * p) / (good.sum() + BUCKETS) / p)


def trusted_ids(labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """At most `sample` ids whose labels all say good and not toxic, by smallest hash."""
    ids = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0")
    return ids.select(F.col("doc_id").alias("id")).orderBy(F.xxhash64("id"), "id").limit(sample)


def assess(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = -0.5, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """docs with STATS, llr, base_failed and kept.  A null, empty or blank text has no words; without labels every llr is 0.

    Texts of any length count whole.  Rows keep their other columns (one with the name of an added one is replaced) and
    repeated rows stay and count.  Ids with a label of either kind, or null ones, are not trusted.  An llr at the
    threshold is kept.  An empty table gives an empty result.
    """
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept")
    unit = float(1 << SCALE)
    # whole numbers, so that a document's sum does not depend on its neighbours
    table = docs.sparkSession.sparkContext.broadcast(np.rint(log_ratios(docs, trusted_ids(labels, sample)) * unit).astype(np.int64))
    at = docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        llr = table.value
        for batch in batches:
            b, off = text_bytes(batch.column(at))
            found = []
            for i, j in slices(off):
                x, o = b[off[i] : off[j]], off[i : j + 1] - off[i]
                bucket, first = gram_buckets(x, o)
                found.append([*text_stats(x, o), per_doc_sum(llr[bucket], first) / unit / np.maximum(np.diff(first), 1)])
            cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0)] * 6
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.float64())], names=[*batch.schema.names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"])

    scored = map_batches(docs, run, f"{schema}, {STATS}, llr double")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """The counts, score and verdict of every document; nulls, blanks, long texts, repeats and empty tables as in assess."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = assess(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
