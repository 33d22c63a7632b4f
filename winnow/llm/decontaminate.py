"""Benchmark decontamination on a stored, distributed positional inverted index.

1. `build_index`: texts are dealt in segments of a few MB.  The row of a segment holds its distinct terms (64-bit hashes,
   sorted), how often each occurs, and postings: the sorted word positions of each term.  All tokens of the corpus are
   in it.  The table lies in the shared folder and is dealt by document, so a phrase is matched where its
   document is and postings never move; build it once, search it as often as wanted.
2. `search`: the benchmark is taken in blocks of at most `block_bytes` of text, one after another, each with its result
   written before the next begins.  First the index gives the corpus frequency of each of the block's terms.
   Each window then starts from the postings of its rarest term, shifted by the term's place in the window, and
   intersects them with the lists of its other terms, from rare to common, each shifted by its own place.
   What leaves a segment is the matches.

Only a block's windows are sent to all tasks, and a block's size is bounded.  Results belong to texts (by a 128-bit hash), so
copies share them; they are joined back to documents by that hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import Spans, drop_scratch, hot_values, lookup, map_batches, scratch, slices, spread, squeeze, text_bytes, unsqueeze, words_of

SEGMENT_BYTES = 4 << 20
#: Word bytes: 0-9, a-z (after lower-casing A-Z) and all bytes beyond ASCII.
GAPS = np.zeros(256, dtype=bool)
GAPS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The same rule as a pattern over lower-cased text, and over text as it is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPANS = "array<struct<first:bigint,past:bigint>>"
INDEX = "seg bigint, texts binary, first binary, terms binary, counts binary, positions binary"


def term_hashes(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each document)."""
    found, first = [np.zeros(0, dtype=np.uint64)], [np.zeros(1, dtype=np.int64)]
    for i, j in slices(off):  # a word's hash does not depend on its place
        x = LOWER[b[off[i] : off[j]]]
        starts, ends, begin = words_of(x, off[i : j + 1] - off[i], GAPS)
        found.append(Spans(x).hashes(starts, ends))
        first.append(begin[1:] + first[-1][-1])
    return np.concatenate(found), np.concatenate(first)


def text_key(text: F.Column) -> F.Column:
    """16 bytes that stand for a text; null for a null one."""
    return F.unhex(F.md5(text.cast("string")))


# ---------------------------------------------------------------- the index


def postings(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct terms, how often each occurs, word positions by term and place)."""
    order = np.argsort(h, kind="stable")
    found = h[order]
    cut = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1], [True]))) if len(h) else np.zeros(1, np.int64)
    return found[cut[:-1]], np.diff(cut), order


def build_index(docs: DataFrame, text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of all texts of docs, written to the shared folder: a row for each segment of at most about segment_bytes
    (a longer text is a segment of its own).  Texts without words are in it, with no postings; a null text is not."""
    slim = docs.where(F.col(text_col).isNotNull()).select(text_key(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys = batch.column(0)
            b, off = text_bytes(batch.column(1))
            for i, j in slices(off, segment_bytes):
                h, first = term_hashes(b[off[i] : off[j]], off[i : j + 1] - off[i])
                terms, counts, places = postings(h)
                seg += 1
                row = [seg, b"".join(keys.slice(i, j - i).to_pylist()), squeeze(np.diff(first)), squeeze(np.diff(terms, prepend=np.uint64(0))), squeeze(counts), squeeze(np.diff(places.astype(np.uint32), prepend=np.uint32(0)))]
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *[pa.array([x], pa.binary()) for x in row[1:]]], names=["seg", "texts", "first", "terms", "counts", "positions"])

    return scratch(map_batches(slim, run, INDEX), "index")


# ---------------------------------------------------------------- the benchmark


class Phrases:
    """The windows of a block of benchmark items, by length, over a sorted vocabulary of term hashes."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int):
        b, off = text_bytes(pa.array(texts, pa.large_string()))
        h, first = term_hashes(b, off)
        self.vocabulary, term = np.unique(h, return_inverse=True)
        rows: dict[tuple[int, ...], set[int]] = {}
        names: dict[str, int] = {}
        for k in range(len(ids)):
            words = term[first[k] : first[k + 1]].tolist()
            item = names.setdefault("" if ids[k] is None else ids[k], len(names))
            for i in range(max(1, len(words) - window + 1) if words else 0):
                rows.setdefault(tuple(words[i : i + window]), set()).add(item)
        self.names = list(names)
        self.by_length = []
        for n in sorted({len(x) for x in rows}):
            phrases = [x for x in rows if len(x) == n]
            items = [sorted(rows[x]) for x in phrases]
            self.by_length.append((np.array(phrases, dtype=np.int64), np.array([len(x) for x in items]), np.array([y for x in items for y in x], dtype=np.int64)))

    def order(self, frequency: np.ndarray) -> None:
        """Drops windows with a term the corpus has not got; self.rare: the places of each window's terms, rarest first."""
        self.rare = []
        for k, (windows, n_items, items) in enumerate(self.by_length):
            alive = (frequency[windows] > 0).all(axis=1)
            of = np.repeat(np.arange(len(windows)), n_items)
            self.by_length[k] = windows[alive], n_items[alive], items[alive[of]]
            self.rare.append(np.argsort(frequency[windows[alive]], axis=1, kind="stable"))


def frequencies(index: DataFrame, phrases: Phrases) -> np.ndarray:
    """How often the corpus has each term of the block."""
    shared = index.sparkSession.sparkContext.broadcast(phrases.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(len(own), dtype=np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1)):
                has, n = np.cumsum(unsqueeze(terms.as_py()), dtype=np.uint64), unsqueeze(counts.as_py())
                if len(has):
                    at = np.minimum(np.searchsorted(has, own), len(has) - 1)
                    total += np.where(has[at] == own, n[at], 0).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(len(phrases.vocabulary), dtype=np.int64)
    found = map_batches(index.select("terms", "counts"), run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the block at most
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    shared.destroy()
    return out


# ---------------------------------------------------------------- matching in a segment


class Lists:
    """The postings of a block's vocabulary in one segment."""

    def __init__(self, vocabulary: np.ndarray, terms: np.ndarray, counts: np.ndarray, places: np.ndarray, first: np.ndarray):
        self.first, self.n = first, int(first[-1])
        at = np.minimum(np.searchsorted(terms, vocabulary), max(len(terms) - 1, 0))
        has = terms[at] == vocabulary if len(terms) else np.zeros(len(vocabulary), dtype=bool)
        before = np.cumsum(counts) - counts
        self.length = np.where(has, counts[at], 0) if len(terms) else np.zeros(len(vocabulary), np.int64)
        self.begin = np.cumsum(self.length) - self.length
        pick = np.repeat((before[at] if len(terms) else self.begin) - self.begin, self.length) + np.arange(int(self.length.sum()))
        self.places = places[pick].astype(np.int64)
        #: term and place in one sorted number
        self.keys = np.repeat(np.arange(len(vocabulary)), self.length) * (self.n + 1) + self.places
        self.doc_of = lambda word: np.searchsorted(first, word, side="right") - 1

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(term), dtype=bool)
        wanted = term * (self.n + 1) + place
        return self.keys[np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)] == wanted

    def seeds(self, windows: np.ndarray, rarest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of each occurrence of a window's rarest term, where the segment has all of its terms."""
        alive = np.flatnonzero((self.length[windows] > 0).all(axis=1))
        term = windows[alive, rarest[alive]]
        n = self.length[term]
        return np.repeat(alive, n), self.places[np.repeat(self.begin[term] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]

    def exact(self, windows: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first word, past word) of every occurrence."""
        size = windows.shape[1]
        which, seed = self.seeds(windows, rare[:, 0])
        start = seed - rare[which, 0]
        ok = (start >= 0) & (start + size <= self.n)
        which, start = which[ok], start[ok]
        ok = self.doc_of(start) == self.doc_of(start + size - 1)
        which, start = which[ok], start[ok]
        for k in range(1, size):
            place = rare[which, k]
            ok = self.has(windows[which, place], start + place)
            which, start = which[ok], start[ok]
        return which, start, start + size

    def near(self, windows: np.ndarray, rare: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first word, past word) of the smallest runs of at most slop more words than the window has, within a
        document, that hold all its words, as often as it has them, in any order."""
        out = []
        reach = windows.shape[1] + slop
        which, seed = self.seeds(windows, rare[:, 0])
        for w in np.unique(which).tolist():
            need = dict(zip(*(x.tolist() for x in np.unique(windows[w], return_counts=True))))
            own = np.sort(seed[which == w])
            # stretches of words around the rarest term, within documents, overlapping ones as one
            doc = self.doc_of(own)
            low, high = np.maximum(own - reach + 1, self.first[doc]), np.minimum(own + reach, self.first[doc + 1])
            new = np.flatnonzero(np.concatenate(([True], (low[1:] >= high[:-1]) | (doc[1:] != doc[:-1]))))
            for x, y in zip(low[new].tolist(), high[np.append(new[1:], len(high)) - 1].tolist()):
                found = []
                for t in need:
                    i, j = np.searchsorted(self.keys, [t * (self.n + 1) + x, t * (self.n + 1) + y])
                    found += [(p, t) for p in (self.keys[i:j] - t * (self.n + 1)).tolist()]
                found.sort()
                have, left, ends = dict.fromkeys(need, 0), 0, []
                lacking = len(need)
                for k, (p, t) in enumerate(found):
                    have[t] += 1
                    lacking -= have[t] == need[t]
                    while not lacking:
                        q, u = found[left]
                        if have[u] == need[u]:
                            break
                        have[u] -= 1
                        left += 1
                    if not lacking:
                        q, u = found[left]
                        if p + 1 - q <= reach and (not ends or ends[-1][0] != q):
                            ends.append((q, p + 1))
                out += [(w, q, e) for q, e in ends]
        cols = np.array(out, dtype=np.int64).reshape(-1, 3)
        return cols[:, 0], cols[:, 1], cols[:, 2]


def match(lists: Lists, phrases: Phrases, slop: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hit words as a mask, and pairs document - item) of one segment."""
    edge, pairs = np.zeros(lists.n + 1, dtype=np.int64), [np.zeros((2, 0), dtype=np.int64)]
    for (windows, n_items, items), rare in zip(phrases.by_length, phrases.rare):
        which, start, past = lists.exact(windows, rare) if slop is None else lists.near(windows, rare, slop)
        np.add.at(edge, start, 1)
        np.add.at(edge, past, -1)
        k = n_items[which]
        item_at = (np.cumsum(n_items) - n_items)[which]
        found = items[np.repeat(item_at - np.cumsum(k) + k, k) + np.arange(int(k.sum()))]
        pairs.append(np.stack([np.repeat(lists.doc_of(start), k), found]))
    both = np.unique(np.concatenate(pairs, axis=1), axis=1)
    return np.cumsum(edge)[: lists.n] > 0, both[0], both[1]


def _spans(hit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of hit words within documents: (document, first, past), counted from the document's first word."""
    edge = np.zeros(len(hit) + 1, dtype=bool)
    edge[first] = True
    doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    before = np.concatenate(([False], hit[:-1]))
    after = np.concatenate((hit[1:], [False]))
    a = np.flatnonzero(hit & (~before | edge[:-1]))
    z = np.flatnonzero(hit & (~after | edge[1:])) + 1
    d = doc_of[a]
    return d, a - first[d], z - first[d]


# ---------------------------------------------------------------- search


def _search_block(index: DataFrame, phrases: Phrases, slop: int | None) -> DataFrame:
    phrases.order(frequencies(index, phrases))
    shared = index.sparkSession.sparkContext.broadcast(phrases)
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                texts, first, terms, counts, places = (batch.column(c)[row].as_py() for c in range(1, 6))
                first = np.concatenate(([0], np.cumsum(unsqueeze(first).astype(np.int64))))
                lists = Lists(own.vocabulary, np.cumsum(unsqueeze(terms), dtype=np.uint64), unsqueeze(counts).astype(np.int64), np.cumsum(unsqueeze(places), dtype=np.uint32), first)
                hit, doc, item = match(lists, own, slop)
                spans: dict[int, list] = {}
                for d, a, z in zip(*(x.tolist() for x in _spans(hit, first))):
                    spans.setdefault(d, []).append({"first": a, "past": z})
                items: dict[int, list] = {}
                for d, k in zip(doc.tolist(), item.tolist()):
                    items.setdefault(d, []).append(own.names[k])
                docs = sorted(items)
                if docs:
                    yield pa.record_batch([pa.array([texts[16 * d : 16 * d + 16] for d in docs], pa.binary()), pa.array([spans[d] for d in docs], span_type), pa.array([sorted(items[d]) for d in docs], pa.list_(pa.string()))], names=["key", "spans", "items"])

    found = map_batches(index.select("seg", "texts", "first", "terms", "counts", "positions"), run, f"key binary, spans {SPANS}, items array<string>")
    out = scratch(found.dropDuplicates(["key"]), "matches")
    shared.destroy()
    return out


def merged(spans: F.Column) -> F.Column:
    """Spans in order, those that touch or overlap made one."""

    def add(out: F.Column, x: F.Column) -> F.Column:
        last = F.element_at(out, -1)
        grown = F.struct(last["first"].alias("first"), F.greatest(last["past"], x["past"]).alias("past"))
        return F.when((F.size(out) > 0) & (x["first"] <= F.try_element_at(out, F.lit(-1))["past"]), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(grown))).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.expr(f"cast(array() as {SPANS})"), add)


def search(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", window: int = 10, slop: int | None = None, block_bytes: int = 4 << 20) -> DataFrame:
    """(key, spans, items) of each text of the index with a match: runs of hit words, and sorted ids of the items.

    A window is `window` consecutive words of an item (a shorter item that has words is one window).  With slop, a window also
    matches a run of at most that many more words that holds all its words, as often, in any order.  An item
    without words never matches; a null item id counts as the empty id; an id on several rows is one item.
    """
    items = scratch(benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null").distinct(), "items")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    found = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()  # about block_bytes of text
        one = _search_block(index, Phrases([r.id for r in rows], [r.text for r in rows], window), slop)
        found = one if found is None else found.unionByName(one)
    drop_scratch(items)
    if blocks == 1:
        return found
    sums = found.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return scratch(sums.select("key", merged(F.col("spans")).alias("spans"), F.array_sort(F.array_distinct("items")).alias("items")), "matches")


def contamination(docs: DataFrame, benchmark: DataFrame, key_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", broadcast_texts: int = 100_000, **how) -> DataFrame:
    """One row per row of docs: the key columns, text, n_words, spans (runs of hit words) and items (sorted ids).

    Null, empty and blank texts have no words and no matches; texts of any length take part whole; repeated rows all
    stay; an empty table, or an empty benchmark, gives no matches.  Other columns of docs are left out unless named
    in key_cols; those with the name of an added one always are.  For items, windows and slop see `search`.
    """
    key_cols = tuple(c for c in key_cols if c not in ("text", "n_words", "spans", "items", "key"))
    own = docs.select(*[F.col(c) for c in key_cols], F.col(text_col).cast("string").alias("text"))
    index = build_index(own)
    found = search(index, benchmark, **how)
    drop_scratch(index)
    marked = own.withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(ANY_WORD)), F.lit(0)).cast("bigint")).withColumn("key", text_key(F.col("text")))
    if found.count() <= broadcast_texts:
        joined = marked.join(F.broadcast(found), "key", "left")
    else:
        joined = lookup(spread(marked, "_spread"), "key", found, hot_values(own.select(text_key(F.col("text")).alias("key")), "key"), "_spread")
    none = [F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")]
    return joined.select(*key_cols, "text", "n_words", *none)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", broadcast_texts: int = 1_000_000, **how) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs; null texts stay."""
    index = build_index(docs, text_col)
    found = search(index, benchmark, **how).select(F.col("key").alias("_key"))
    drop_scratch(index)
    marked = docs.withColumn("_key", text_key(F.col(text_col)))
    if found.count() <= broadcast_texts:
        return marked.join(F.broadcast(found), "_key", "left_anti").drop("_key")
    hot = hot_values(docs.select(text_key(F.col(text_col)).alias("_key")), "_key")
    return lookup(spread(marked, "_spread"), "_key", found.withColumn("_hit", F.lit(True)), hot, "_spread").where("_hit is null").drop("_key", "_hit", "_spread")


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Hit words and items of every document; nulls, blanks, long texts, repeats and empty tables as in contamination."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["past"] - x["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_WORDS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
ORACLE_SQL = {
    "op10_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, w[i : i + 9] AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(x) AS n FROM p),
v AS (SELECT r, n, i, w[i : i + n - 1] AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
m AS (SELECT r, i, n, item_id FROM v JOIN p USING (x)),
h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
""",
}
