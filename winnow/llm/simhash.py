"""SimHash near-duplicates by the generalised pigeonhole principle.

1. `fingerprints`: a 64-bit SimHash of each whole text over word shingles.
2. `plan_masks`: bits that agree more often than chance are grouped into partitions, and each partition gets its
   own threshold by dynamic programming over estimated candidate counts, all from statistics of every fingerprint.
   If m partitions have thresholds t1..tm with sum d-m+1, two fingerprints within d bits are within ti in some
   partition i.  A partition with threshold -1 needs no probe.  "Within t in w bits" becomes agreement on the
   w-t bits left after masking some t of them, so all probes are equi-joins on (mask, masked value).
3. `link_fingerprints`: buckets of equal (mask, value) are verified.  A bucket over `bucket_rows` is never brought
   together: its rows are dealt anew over d+1 masks, each with another part of its free bits, of which one part must
   agree for any two rows within d bits - or, once no more than d free bits are left, all its rows are linked.  For
   d over 3, where that would multiply too often, it is cut into blocks instead, and pairs of blocks are compared.

Only distinct fingerprints take part, so copies of a text never make pairs.  A crowded bucket gives a star per
connected component of its links instead of all links, so what leaves it grows with its rows.

Near-copies by Jaccard similarity are not left to SimHash alone, which misses many at 0.8 (such texts differ in about 10
of 64 bits): `near_duplicates` links close copies by SimHash, verifies them, and then takes every pair of texts not linked
yet that exact prefix filtering leaves (see `prefix_edges`).  Families of crowded prefixes whose texts are still in
several groups are compared whole, but for texts of one group (see `family_links`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .kit import drop_scratch, lookup, map_batches, release, scramble, scratch, slices, spread, squeeze, text_bytes, unsqueeze, words_of

BITS = 64
FULL = (1 << BITS) - 1


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(b: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of each shingle, and the number of shingles of each document."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    starts, ends, first = words_of(b, off)
    n_words = np.diff(first)
    length = ends - starts
    new_start = np.cumsum(length + 1) - length - 1
    flat = np.full(int(length.sum() + len(length)), 0x20, dtype=np.uint8)
    at = np.repeat(new_start - starts, length) + (inside := np.repeat(starts - np.cumsum(length) + length, length) + np.arange(int(length.sum())))
    flat[at] = lower[b[inside]]
    counts = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    begin = np.repeat(first[:-1] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
    last = begin + np.repeat(np.minimum(n_words, size), counts) - 1
    text, hash64 = flat.tobytes(), xxhash.xxh64_intdigest
    s, e = new_start[begin].tolist() if len(begin) else [], (new_start[last] + length[last]).tolist() if len(begin) else []
    return np.fromiter((hash64(text[i:j], 42) for i, j in zip(s, e)), dtype=np.uint64, count=len(s)), counts


def simhash(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A bit is 1 if set in over half of a document's hashes; no hashes: 0."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    at = np.concatenate(([0], np.cumsum(counts[full])))
    for i in range(0, len(full), 4096):
        j = min(i + 4096, len(full))
        bits = np.unpackbits(hashes[at[i] : at[j]].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, at[i:j] - at[i], axis=0, dtype=np.int32)
        ones = np.packbits(2 * sums > counts[full[i:j]][:, None], axis=1)
        out[full[i:j]] = ones.reshape(-1, 8).view(">u8").ravel().astype(np.uint64)
    return out


def shingle_sets(b: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each document, sorted."""
    hashes, counts = shingle_hashes(b, off, size)
    at = np.concatenate(([0], np.cumsum(counts))).tolist()
    return [np.unique(hashes[x:y]) for x, y in zip(at, at[1:])]


def rehash(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th family of hashes; family 0 is the hashes themselves."""
    return hashes if k == 0 else scramble(hashes + np.uint64(k * 0x9E3779B97F4A7C15 & FULL))


class Prefix:
    """Of a set of n shingle hashes, the first n - ceil(similarity n) + 1 in an order that all sets share.

    Two sets whose Jaccard similarity is at least `similarity` have a hash in common among these, whatever the order.
    The order puts hashes in `common` (sorted; `counts` says how common) last, and before them by level those whose slot in
    `levels` (a power of two of them, or none) says that they repeat: so these seldom are in a prefix.
    """

    def __init__(self, similarity: float, common: np.ndarray, counts: np.ndarray, levels: np.ndarray):
        self.similarity, self.common, self.counts, self.levels = similarity, common, counts, levels

    def of(self, x: np.ndarray) -> np.ndarray:
        size = len(x) - math.ceil(self.similarity * len(x) - 1e-9) + 1 if len(x) else 0
        if not len(self.levels) and not len(self.common):
            return x[:size]
        count = self.levels[x & np.uint64(len(self.levels) - 1)].astype(np.int64) if len(self.levels) else np.zeros(len(x), dtype=np.int64)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, x), len(self.common) - 1)
            count = np.where(self.common[at] == x, 256 + self.counts[at], count)
        return x[np.argsort(count, kind="stable")[:size]]


def fingerprints(docs: DataFrame, key_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", shingle: int = 3, distinct: bool = False, families: int = 1, prefix: Prefix | None = None) -> DataFrame:
    """(*key_cols, fps array<bigint>) per row of docs: a fingerprint for each family of hashes.

    A null, empty or blank text has fingerprints 0; repeated rows stay.  A bit is a majority over the text's
    shingles, repeats included, or over the distinct ones.  With prefix (and distinct), also n int, the number of
    distinct shingles, and prefix binary, those of them that prefix.of() takes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, off = text_bytes(batch.column(len(key_cols)))
            found, n, heads = [], [], []
            for i, j in slices(off):
                if distinct:
                    sets = shingle_sets(b[off[i] : off[j]], off[i : j + 1] - off[i], shingle)
                    hashes, counts = np.concatenate(sets), np.array([len(x) for x in sets])
                    if prefix:
                        n.extend(len(x) for x in sets)
                        heads.extend(prefix.of(x).tobytes() for x in sets)
                else:
                    hashes, counts = shingle_hashes(b[off[i] : off[j]], off[i : j + 1] - off[i], shingle)
                found.append(np.stack([simhash(rehash(hashes, k), counts) for k in range(families)], axis=1))
            fps = np.concatenate(found) if found else np.zeros((0, families), np.uint64)
            packed = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1) * families, pa.int32()), pa.array(fps.ravel().view(np.int64)))
            more = [pa.array(n, pa.int32()), pa.array(heads, pa.binary())] if prefix else []
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key_cols)], packed, *more], names=[*batch.schema.names[: len(key_cols)], "fps", *["n", "prefix"][: len(more)]])

    slim = docs.select(*key_cols, F.col(text_col).cast("string").alias("_text"))
    return map_batches(slim, run, ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in key_cols) + ", fps array<bigint>" + ", n int, prefix binary" * (prefix is not None))


# ---------------------------------------------------------------- the plan: partitions and thresholds


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """(number of fingerprints, 64x64 counts of fingerprints with bits i and j set), over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 1 << 15):
                x = np.unpackbits(fp[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += x.T @ x
                n += len(x)
        yield pa.record_batch([pa.array([-1] + list(range(BITS))), pa.array([[float(n)]] + both.tolist())], names=["bit", "row"])

    sums = (
        map_batches(distinct.select("fp"), run, "bit bigint, row array<double>")
        .select("bit", F.posexplode("row").alias("other", "n"))
        .groupBy("bit", "other").agg(F.sum("n").alias("n")).collect()  # 4,097 rows at most
    )
    n, both = 0, np.zeros((BITS, BITS))
    for r in sums:
        if r.bit < 0:
            n = int(r.n)
        else:
            both[r.bit, r.other] = r.n
    return n, both


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly 64/m bits; each starts at the free bit with the strongest ties and takes the bits most tied to it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    free, groups = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        pool = sorted(free)
        group = [max(pool, key=lambda i: (tie[i, pool].max(), -i))]
        while len(group) < size:
            group.append(max(sorted(free - set(group)), key=lambda i: (tie[i, group].sum(), -i)))
        free -= set(group)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i in -1..len(costs[i])-2 with sum `total` and the least summed costs[i][t_i+1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for s, (v, ts) in best.items():
            for t in range(-1, len(c) - 1):
                if s + t not in after or v + c[t + 1] < after[s + t][0]:
                    after[s + t] = (v + c[t + 1], [*ts, t])
        best = after
    return best.get(total, (math.inf, []))


def plan_masks(n: int, both: np.ndarray, max_bits: int, row_cost: float = 500.0) -> list[int]:
    """The masks to probe.  row_cost: what a probe row costs, in comparisons of a candidate.

    Partitions with thresholds over 3, or with over 2,000 masks, are not weighed; if max_bits allows no other plan, the one
    mask is 0, a bucket of all rows, which link_fingerprints cuts into blocks like any other that is too large.
    """
    p = np.diag(both) / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)
    best, masks = math.inf, [0]
    for m in range(1, min(max_bits + 1, 8) + 1):
        groups = group_bits(n, both, m)
        costs = []
        for g in groups:
            c = [0.0]
            for t in range(min(3, max_bits) + 1):
                keys = math.comb(len(g), t)
                mates = 0.5 * n * float(np.exp(np.log(agree[g]).mean() * (len(g) - t)))
                c.append(n * keys * (row_cost + mates) if keys <= 2000 else math.inf)
            costs.append(c)
        cost, ts = allocate(costs, max_bits - m + 1)
        if cost < best:
            best = cost
            masks = [sum(1 << b for b in g if b not in drop) for g, t in zip(groups, ts) if t >= 0 for drop in combinations(g, t)]
    return masks


# ---------------------------------------------------------------- probe and verify


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(x: np.ndarray, max_bits: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """All i < j with x[i] and x[j] within max_bits bits, compared in blocks of rows."""
    found = [np.zeros((2, 0), dtype=np.int64)]
    for k in range(0, len(x), rows):
        i, j = np.nonzero(np.bitwise_count(x[k : k + rows, None] ^ x[None, k:]) <= max_bits)
        found.append(np.stack([i[i < j] + k, j[i < j] + k]))
    return tuple(np.concatenate(found, axis=1))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first row of each row's component."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, j, label[i])
        np.minimum.at(new, i, label[j])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _star(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per connected component of the links (i, j)."""
    label = _forest(len(x), i, j)
    own = np.flatnonzero(label != np.arange(len(x)))
    return x[own], x[label[own]]


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(columns, sizes of the groups in them) of rows sorted by their first `by` columns, groups never cut."""
    rest: list[list[np.ndarray]] = []  # pieces of the last group, joined once it ends
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:by]])) + 1
        if rest and any(c[0] != z[-1] for c, z in zip(cols[:by], rest[-1])):
            yield _joined(rest), np.array([sum(len(z[0]) for z in rest)])
            rest = []
        if len(cut):
            before = sum(len(z[0]) for z in rest)
            whole = int(cut[-1])
            yield _joined([*rest, [c[:whole] for c in cols]]), np.diff(np.concatenate(([0], cut + before)))
            rest = [[c[whole:] for c in cols]]
        else:
            rest.append(cols)
    if rest:
        yield _joined(rest), np.array([sum(len(z[0]) for z in rest)])


def _joined(pieces: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(z) for z in zip(*pieces)] if len(pieces) > 1 else pieces[0]


def bucket_edges(max_bits: int, small: int = 64, dense: int = 4):
    """A mapInArrow function over rows (mask, val, fp) sorted by (mask, val), buckets not cut between tasks.

    A bucket with over `dense` links a row gives a star per component of them, so what leaves a bucket grows with its rows.
    """

    def one(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.sort(x)
        i, j = _near(x, max_bits)
        return (x[i], x[j]) if len(i) <= dense * len(x) else _star(x, i, j)

    def edges(fp: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = np.cumsum(size) - size
        for c in np.unique(size[(size > 1) & (size <= small)]).tolist():
            rows = at[size == c]
            step = max(1, (1 << 18) // (c * c))
            i, j = np.triu_indices(c, 1)
            for k in range(0, len(rows), step):
                block = fp[rows[k : k + step, None] + np.arange(c)]
                hit, which = np.nonzero(np.bitwise_count(block[:, i] ^ block[:, j]) <= max_bits)
                crowded = np.bincount(hit, minlength=len(block)) > dense * c
                plain = ~crowded[hit]
                yield block[hit[plain], i[which[plain]]], block[hit[plain], j[which[plain]]]
                for b in np.flatnonzero(crowded).tolist():
                    yield one(block[b])
        for k in np.flatnonzero(size > small).tolist():
            yield one(fp[at[k] : at[k] + size[k]])

    def out(fp: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = list(edges(fp, size))
        if found:
            a, b = (np.concatenate(z) for z in zip(*found))
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.record_batch([pa.array(pair[0].view(np.int64)), pa.array(pair[1].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, fp), size in _groups(batches, 2):
            yield from out(fp.view(np.uint64), size)

    return run


def _deal(rows: DataFrame, masks: list[int]) -> DataFrame:
    each = F.explode(F.array(*[F.lit(_signed(x)) for x in masks])).alias("mask")
    return rows.select("fp", each).select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("val"), "fp")


def _block_pairs(hot: DataFrame, rows: int) -> DataFrame:
    """Oversized buckets cut into blocks of about `rows`; each pair of blocks becomes a bucket of its own.

    Any two rows of a bucket meet in some pair, no task holds more than two blocks, and a pair gives edges in
    proportion to its rows.
    """
    blocks = F.ceil(F.col("n") / rows)
    dealt = hot.withColumn("i", F.pmod(F.xxhash64("fp"), blocks)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    key = F.xxhash64("mask", "val", F.least("i", "j"), F.greatest("i", "j"))
    return dealt.select("mask", key.alias("val"), "fp").repartition("mask", "val").sortWithinPartitions("mask", "val")


def link_fingerprints(distinct: DataFrame, max_bits: int, bucket_rows: int = 4096) -> DataFrame:
    """(a, b) edges whose components are those of all links, that is pairs of fingerprints within max_bits bits.

    distinct: one bigint column fp without repeats or nulls.
    """
    n, both = bit_statistics(distinct)
    masks = plan_masks(n, both, max_bits) if n > 1 else [FULL]
    order = [b for g in group_bits(n, both, 3) for b in g]
    found, rows = [], distinct
    keys = _deal(rows, masks)
    while True:
        sizes = keys.groupBy("mask", "val").agg(F.count("*").alias("n")).where("n > 1")
        shared = scratch(keys.join(sizes, ["mask", "val"]), "buckets")
        ready = shared.where(F.col("n") <= bucket_rows).select("mask", "val", "fp").repartition("mask", "val").sortWithinPartitions("mask", "val")
        found.append(map_batches(ready, bucket_edges(max_bits), "a bigint, b bigint"))
        hot = shared.where(F.col("n") > bucket_rows)
        hot_masks = [r.mask & FULL for r in hot.select("mask").distinct().collect()]  # masks of one level, fixed by the plan
        if not hot_masks:
            break
        if max_bits > 3:  # finer masks would multiply by max_bits + 1 at each level
            found.append(map_batches(_block_pairs(hot, bucket_rows // 2), bucket_edges(max_bits), "a bigint, b bigint"))
            break
        split, alike = {}, []
        for mask in hot_masks:
            free = [b for b in order if not mask >> b & 1]
            if len(free) <= max_bits:
                alike.append(mask)
            else:
                split[mask] = [mask | sum(1 << int(b) for b in part) for part in np.array_split(np.array(free), max_bits + 1)]
        if alike:
            same = hot.where(F.col("mask").isin([_signed(x) for x in alike]))
            low = same.groupBy("mask", "val").agg(F.min("fp").alias("b"))
            found.append(same.join(low, ["mask", "val"]).where("fp != b").select(F.col("fp").alias("a"), "b"))
        if not split:
            break
        finer = F.create_map(*[x for k, v in split.items() for x in (F.lit(_signed(k)), F.array(*[F.lit(_signed(y)) for y in v]))])
        keys = hot.where(F.col("mask").isin([_signed(x) for x in split])).select("fp", F.explode(finer[F.col("mask")]).alias("mask")).distinct().select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("val"), "fp")
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def hex_fingerprint(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per row of docs: (id, fp, component): fingerprints within max_bits are linked, and component is the
    smallest id that links reach.  Ids may repeat or be null; a component of null ids only has a null component.
    An empty table gives an empty result; blank texts share fingerprint 0 and so a component.
    """
    marked = scratch(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ("id",), "text", shingle).select("id", F.col("fps")[0].alias("fp")), "fingerprints")
    distinct = scratch(marked.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "distinct")
    roots = components(link_fingerprints(distinct.select("fp"), max_bits), "a", "b")
    of = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("low").alias("component"))
    total = marked.count()
    hot = [r.fp for r in distinct.where((F.col("n") > 1000) & (F.col("n") * 1000 > total)).select("fp").collect()]  # a thousand at most
    return lookup(spread(marked, "spread"), "fp", of.join(least, "root").select("fp", "component"), hot, "spread").select("id", "fp", "component")


# ---------------------------------------------------------------- exact candidates by prefixes


#: Slots of the table of levels, and of each part of it that a task packs.
SLOTS, PART = 1 << 23, 1 << 15


def shingle_levels(repeated: DataFrame) -> np.ndarray:
    """For each slot (a hash's low bits) a level that grows with the count of its most frequent hash in repeated (hash, n); 0 if
    none.  The rarest counts are left out where they would fill over half of the slots.  Parts of the table are packed in tasks:
    8 MB reach the driver at most, however many hashes there are."""
    least, held = 0, 0
    for n, rows in sorted(map(tuple, repeated.groupBy(F.least("n", F.lit(4096)).alias("n")).agg(F.count("*")).collect()), reverse=True):
        held += rows
        if held > SLOTS // 2:
            break
        least = n
    if not least:
        return np.zeros(0, dtype=np.uint8)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, slot, level), size in _groups(batches, 1):
            for a, c in zip((np.cumsum(size) - size).tolist(), size.tolist()):
                own = np.zeros(PART, dtype=np.uint8)
                np.maximum.at(own, slot[a : a + c] % PART, level[a : a + c].astype(np.uint8))
                yield pa.record_batch([pa.array(part[a : a + 1]), pa.array([squeeze(own)], pa.binary())], names=["part", "levels"])

    slot = F.col("hash").bitwiseAND(F.lit(SLOTS - 1))
    level = F.least(F.lit(255.0), F.floor(8 * F.log2("n"))).cast("bigint")
    dealt = repeated.where(F.col("n") >= least).select(F.floor(slot / PART).alias("part"), slot.alias("slot"), level.alias("level"))
    levels = np.zeros(SLOTS, dtype=np.uint8)
    for r in map_batches(dealt.repartition("part").sortWithinPartitions("part"), pack, "part bigint, levels binary").collect():
        levels[r.part * PART : (r.part + 1) * PART] = unsqueeze(r.levels)
    return levels


def common_shingles(docs: DataFrame, text_col: str, shingle: int, sample: int = 20_000, share: int = 8, least: int = 4, most: int = 200_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes, counts, levels): the shingles that at least `least` in `sample` texts hold, and shingle_levels of those
    that two texts hold, of about `sample` texts or one in `share`, whichever is more.  They only order prefixes, so which
    texts are looked at changes the cost, never the result.  What is not seen twice is held by some 2 * share texts, so
    buckets of such shingles stay as small when the table grows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, off = text_bytes(batch.column(0))
            for i, j in slices(off):
                found, n = np.unique(np.concatenate(shingle_sets(b[off[i] : off[j]], off[i : j + 1] - off[i], shingle)), return_counts=True)
                yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(n)], names=["hash", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    total = texts.count()
    parts = max(1, min(share, total // sample))
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == 0).distinct()
    repeated = scratch(map_batches(some, run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1"), "repeated")
    enough = max(least, least * (total // parts) // sample)
    rows = repeated.where(F.col("n") >= enough).orderBy(F.desc("n"), "hash").limit(most).toArrow()
    hashes = rows["hash"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    levels = shingle_levels(repeated)
    drop_scratch(repeated)
    return hashes[order], rows["n"].to_numpy()[order], levels


def prefix_rows(texts: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """(hash, key, root, n, left) for each hash in a text's prefix; left: how many of its n hashes stand from there on.
    only: sorted hashes, for rows of these alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                b, off = text_bytes(part.column(3))
                size = np.diff(off) // 8
                key, root, n = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), size) for c in (0, 1, 2))
                place = np.arange(len(n)) - np.repeat(np.cumsum(size) - size, size)
                cols = [np.frombuffer(b.tobytes(), np.int64), key, root, n, (n - place).astype(np.int32)]
                if only is not None:
                    x = cols[0].view(np.uint64)
                    stay = only[np.minimum(np.searchsorted(only, x), len(only) - 1)] == x
                    cols = [c[stay] for c in cols]
                yield pa.record_batch([pa.array(c) for c in cols], names=["hash", "key", "root", "n", "left"])

    return map_batches(texts.select("near_key", "root", "n", "prefix"), run, "hash bigint, key bigint, root bigint, n int, left int")


def dealt_prefixes(texts: DataFrame, common: np.ndarray, most: int = 1024, salts: int = 256) -> DataFrame:
    """The rows of prefix_rows for prefix_edges: (hash, salt, key, root, n, left, low), one hash and salt in one task, in order.

    The hashes in `common` that over `most` prefixes hold are counted before anything is shuffled.  Their rows get a salt
    and `low`, the smallest key with that hash, to which each is a spoke on its own; if all texts with the hash have
    one root, they go.  Other rows have salt -1.  There are as many such hashes as `common` has entries at most.
    """
    rows = prefix_rows(texts)
    if len(common):
        held = prefix_rows(texts, common).groupBy("hash").agg(F.count("*").alias("c"), F.min("key").alias("low"), F.min("root").alias("r1"), F.max("root").alias("r2"))
        crowded = held.where(F.col("c") > most).select("hash", "low", (F.col("r1") == F.col("r2")).alias("one"))
        rows = rows.join(F.broadcast(crowded), "hash", "left").where("one is null or not one")
    else:
        rows = rows.withColumn("low", F.lit(None).cast("bigint"))
    salt = F.when(F.col("low").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("key"), F.lit(salts))).cast("int")
    rows = rows.select("hash", salt.alias("salt"), "key", "root", "n", "left", F.coalesce("low", "key").alias("low"))
    return rows.repartition("hash", "salt").sortWithinPartitions("hash", "salt")


def prefix_edges(similarity: float, small: int = 64, most: int = 1024, dense: int = 2):
    """A mapInArrow function over rows of dealt_prefixes: (a, b, family).

    Texts of different roots that share a hash are a pair, unless so few hashes stand from it on in one of them that
    their similarity can't be reached if it is the first they share.  A bucket of one hash with over `dense` pairs a row
    gives a star per component of its pairs instead, with family set (over `most` rows: one star): its texts are to
    be compared among each other.  So what leaves a bucket grows with its rows, and no pair is lost.  Rows with a salt are
    spokes of one such star.
    """

    def can(root1, n1, left1, root2, n2, left2):
        return (root1 != root2) & (np.minimum(left1, left2) * (1 + similarity) >= similarity * (n1 + n2) - 1e-6)

    def edges(key: np.ndarray, root: np.ndarray, n: np.ndarray, left: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        at = np.cumsum(size) - size

        def star(k: int, c: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
            x = key[k : k + c]
            return (x[i], x[j], False) if len(i) <= dense * c else (*_star(x, i, j), True)

        for c in np.unique(size[(size > 1) & (size <= small)]).tolist():
            rows = at[size == c]
            i, j = np.triu_indices(c, 1)
            step = max(1, (1 << 20) // len(i))
            for k in range(0, len(rows), step):
                start = rows[k : k + step, None]
                x, y = start + i, start + j
                hit, which = np.nonzero(can(root[x], n[x], left[x], root[y], n[y], left[y]))
                crowded = np.bincount(hit, minlength=len(start)) > dense * c
                plain = ~crowded[hit]
                first = start[hit[plain], 0]
                yield key[first + i[which[plain]]], key[first + j[which[plain]]], False
                for b in np.flatnonzero(crowded).tolist():
                    mine = which[hit == b]
                    yield star(int(start[b, 0]), c, i[mine], j[mine])
        for k in np.flatnonzero(size > small).tolist():
            a, c = int(at[k]), int(size[k])
            r, m, f = root[a : a + c], n[a : a + c], left[a : a + c]
            if (r == r[0]).all():
                continue
            if c > most:
                yield key[a + 1 : a + c], np.full(c - 1, key[a]), True
                continue
            i, j = np.nonzero(np.triu(can(r[:, None], m[:, None], f[:, None], r[None], m[None], f[None]), 1))
            yield star(a, c, i, j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, salt, key, *cols, low), size in _groups(batches, 2):
            spoke, found = salt >= 0, []
            if spoke.any():
                far = spoke & (key != low)
                found.append((key[far], low[far], True))
                size = size[~spoke[np.cumsum(size) - size]]
            found += edges(*(c[~spoke] for c in (key, *cols)), size)
            if found:
                a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
                family = np.concatenate([np.full(len(x[0]), x[2]) for x in found])
                for kind in (False, True):
                    one = family == kind
                    pair = np.unique(np.stack([np.minimum(a[one], b[one]), np.maximum(a[one], b[one])]), axis=1)
                    yield pa.record_batch([pa.array(pair[0]), pa.array(pair[1]), pa.array(np.full(pair.shape[1], kind))], names=["a", "b", "family"])

    return run


def overlaps(sets: list[np.ndarray], rare: int = 8, width: int = 2048) -> np.ndarray:
    """How many hashes each two sets have in common."""
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    of = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(of, kind="stable")
    owner, count = owner[order], np.bincount(of)
    at = np.cumsum(count) - count
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for c in range(2, rare + 1):  # hashes of few sets: their pairs; others: columns of 0 and 1
        held = owner[at[count == c][:, None] + np.arange(c)]
        for i, j in combinations(range(c), 2):
            np.add.at(out, (held[:, i], held[:, j]), 1)
    out += out.T
    many = np.flatnonzero(count > rare)
    for k in range(0, len(many), width):
        part = many[k : k + width]
        x = np.zeros((len(sets), len(part)), dtype=np.float32)
        for col, (a, c) in enumerate(zip(at[part].tolist(), count[part].tolist())):
            x[owner[a : a + c], col] = 1
        out += x @ x.T
    return out


def family_edges(similarity: float):
    """A mapInArrow function over rows (task, key, root, hashes) sorted by task: a forest (a, b) of the links of each
    task between texts of different roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, key, root, hashes), size in _groups(batches, 1):
            at = np.cumsum(size) - size
            for k, c in zip(at.tolist(), size.tolist()):
                own = root[k : k + c]
                if (own == own[0]).all():
                    continue
                n = np.array([len(x) // 8 for x in hashes[k : k + c]])
                both, found = overlaps([np.frombuffer(x, dtype=np.uint64) for x in hashes[k : k + c]]), []
                for r in range(0, c, 256):
                    some = both[r : r + 256].astype(np.float64)
                    near = some / np.maximum(1, n[r : r + 256, None] + n - some) >= similarity
                    i, j = np.nonzero(np.triu(near & (own[r : r + 256, None] != own), r + 1))
                    found.append(np.stack([i + r, j]))
                a, b = _star(key[k : k + c], *np.concatenate(found, axis=1))
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def family_links(members: DataFrame, sets: DataFrame, similarity: float, block_bytes: int = 1 << 20, block_rows: int = 512) -> DataFrame:
    """A forest (a, b) of all links within each family between texts of different roots, from members (key, family, root).

    A family over a block's size (`block_bytes` of hashes, `block_rows` rows) is cut into bands by the number of hashes, so
    wide that texts two bands apart cannot reach the similarity: blocks of one band or of neighbouring ones meet.  A
    root over a block's size within a band is cut into blocks of its own; the others of a band share blocks.  Each pair
    of blocks that meet is a task, but for two of one root: so a large group whose texts are linked already meets the
    few other texts of its family, not itself.
    """
    width = max(-math.log(similarity), 1e-3) * (1 + 1e-6)
    band = F.floor(F.log(F.greatest(F.length("hashes") / 8, F.lit(1.0))) / F.lit(width))
    held = members.join(sets, "key").withColumn("band", band)
    size = F.greatest(F.sum(F.length("hashes")) / F.lit(float(block_bytes)), F.count("*") / F.lit(float(block_rows)))
    sizes = scratch(held.groupBy("family", "root", "band").agg(size.alias("size")), "roots")
    whole = sizes.groupBy("family").agg(F.sum("size").alias("whole"))
    own = sizes.join(whole, "family").withColumn("place", F.when(F.col("whole") > 1, F.col("band")).otherwise(F.lit(0)))
    shared = own.where("size <= 1").groupBy("family", "band", "place").agg(F.ceil(F.sum("size")).alias("m"))
    large = own.where("size > 1").select("family", "root", "band", "place", F.ceil("size").alias("n"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)).alias("k")
    number = lambda root, k: F.xxhash64("family", root, "place", k)
    blocks = scratch(
        large.select("family", F.col("root").alias("of"), "place", each("n"))
        .unionByName(shared.select("family", F.lit(None).cast("bigint").alias("of"), "place", each("m")).distinct())
        .select("family", "of", "place", number("of", "k").alias("block")),
        "blocks",
    )
    near = F.explode(F.array(F.col("place") - 1, F.col("place"), F.col("place") + 1)).alias("place")
    other = blocks.select("family", near, F.col("of").alias("of2"), F.col("block").alias("block2"))
    tasks = blocks.join(other, ["family", "place"]).where("block <= block2 and coalesce(of != of2, true)").select(F.xxhash64("block", "block2").alias("task"), F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))
    placed = (
        held.join(large.withColumnRenamed("place", "place1"), ["family", "root", "band"], "left").join(shared.withColumnRenamed("place", "place2"), ["family", "band"], "left")
        .withColumn("place", F.coalesce("place1", "place2"))
        .withColumn("of", F.when(F.col("n").isNotNull(), F.col("root")))
        .withColumn("k", F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("key"), "n")).otherwise(F.pmod(F.xxhash64("root"), "m")))
        .select(number("of", "k").alias("block"), "key", "root", "hashes")
    )
    rows = placed.join(tasks, "block").select("task", "key", "root", "hashes")
    return map_batches(rows.repartition("task").sortWithinPartitions("task"), family_edges(similarity), "a bigint, b bigint")


def common_counts(left: pa.Array, right: pa.Array) -> np.ndarray:
    """How many hashes the two packed sets of each row have in common."""
    sides = [text_bytes(left), text_bytes(right)]
    out = np.zeros(len(left), dtype=np.int64)
    for i, j in slices(sides[0][1] + sides[1][1]):
        hashes = np.concatenate([np.frombuffer(b[off[i] : off[j]].tobytes(), dtype=np.uint64) for b, off in sides])
        row = np.concatenate([np.repeat(np.arange(j - i, dtype=np.uint16), np.diff(off[i : j + 1]) // 8) for _, off in sides])
        order = np.argsort(hashes)
        order = order[np.argsort(row[order], kind="stable")]
        hashes, row = hashes[order], row[order]
        both = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        out[i:j] = np.bincount(row[1:][both], minlength=j - i)
    return out


def set_sizes(col: pa.Array) -> np.ndarray:
    return np.diff(text_bytes(col)[1]) // 8


def promising(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose prefixes do not rule out the similarity.

    Of the prefix that ends first in the shared order, every hash that the other text has is in the other's prefix: so
    texts have at most the hashes common to both prefixes and those behind that prefix in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            n, m = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (4, 5))
            most = common_counts(x, y) + np.maximum(n - set_sizes(x), m - set_sizes(y))
            yield batch.select(["a", "b"]).filter(pa.array(most * (1 + similarity) >= similarity * (n + m) - 1e-6))

    left, right = (texts.select(F.col("near_key").alias(k), F.col("prefix").alias(f"p{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb", "na", "nb"), run, "a bigint, b bigint")


def jaccard(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with their similarity, from sets (key, hashes: packed sorted 64-bit hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            both, total = common_counts(x, y), set_sizes(x) + set_sizes(y)
            found = np.where(total > 0, both / np.maximum(1, total - both), 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["a", "b", "similarity"])

    left, right = (sets.select(F.col("key").alias(k), F.col("hashes").alias(f"h{k}")) for k in "ab")
    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb"), run, "a bigint, b bigint, similarity double")


_NONE = (1 << 63) - 1


class _Near:
    """The texts of a table and the links between them.  Tables it pauses at are removed when the groups are written."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, similarity: float, broadcast_keys: int, key_bits: int = 64):
        self.tables: list[DataFrame] = []
        self.text_col, self.shingle, self.max_bits, self.similarity, self.broadcast_keys = text_col, shingle, max_bits, similarity, broadcast_keys
        self.common = common_shingles(docs, text_col, shingle)
        text = F.col(text_col).cast("string")
        check = F.xxhash64(F.lit(1), text)
        clashing: list[int] = []
        for k in range(4):
            key = F.shiftrightunsigned(F.xxhash64(text), 64 - key_bits) if key_bits < 64 else F.xxhash64(text)
            if clashing:
                key = F.when(key.isin(clashing), F.xxhash64(F.lit(k), F.xxhash64(text), check)).otherwise(key)
            self.keyed = docs.withColumn("near_key", F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(key).cast("bigint"))
            slim = self.keyed.select("near_key", check.alias("check"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NONE)).alias("id"), text.alias("text"))
            marked = fingerprints(slim, ("near_key", "check", "id"), "text", shingle, True, 1, Prefix(similarity, *self.common))
            texts = self.held(marked.groupBy("near_key").agg(F.min("fps")[0].alias("fp"), F.min("id").alias("low"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min("check").alias("check"), F.max("check").alias("check2")), "texts")
            self.texts = texts.drop("check", "check2")
            # different texts with one 64-bit hash: about n * n / 2**65 of n texts, so a few of 10**10; a second hash tells them apart
            found = [r.near_key for r in texts.where("check != check2").select("near_key").collect()]
            if not found:
                break
            clashing += found
            drop_scratch(self.tables.pop())
        else:
            raise RuntimeError("texts of one hash could not be told apart")
        self.is_large = self.texts.count() >= 50_000
        self.freed()

    def freed(self) -> None:
        """After a step with large shuffles: their files go now, not when the driver next happens to collect garbage."""
        if self.is_large:
            release(self.texts.sparkSession)

    def held(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(scratch(df, name))
        return self.tables[-1]

    def sets_of(self, keys: DataFrame) -> DataFrame:
        """(key, hashes: packed sorted distinct shingle hashes) of the texts with these keys."""
        size = self.shingle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                b, off = text_bytes(batch.column(1))
                for i, j in slices(off):
                    sets = shingle_sets(b[off[i] : off[j]], off[i : j + 1] - off[i], size)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([x.tobytes() for x in sets], pa.binary())], names=["key", "hashes"])

        wanted = self.held(keys.distinct(), "wanted")
        few = wanted.count() <= self.broadcast_keys
        held = self.keyed.select("near_key", F.col(self.text_col).cast("string").alias("text")).join(F.broadcast(wanted) if few else wanted, "near_key", "left_semi")
        sets = scratch(map_batches(held, run, "key bigint, hashes binary").groupBy("key").agg(F.first("hashes").alias("hashes")), "sets")
        self.freed()
        return sets

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose similarity is high enough, by their whole sets."""
        pairs = self.held(promising(pairs.distinct(), self.texts, self.similarity), "pairs")
        self.freed()
        sets = self.sets_of(pairs.select(F.explode(F.array("a", "b")).alias("near_key")))
        links = self.held(jaccard(pairs, sets).where(F.col("similarity") >= self.similarity).select("a", "b"), "links")
        drop_scratch(sets)  # the largest of the tables
        self.freed()
        return links

    def close(self) -> DataFrame:
        """Verified links among texts whose fingerprints are within max_bits."""
        first = self.held(self.texts.groupBy("fp").agg(F.min(F.struct("low", "near_key"))["near_key"].alias("rep")), "first")
        edges = link_fingerprints(first.select("fp"), self.max_bits).distinct()
        across = edges.join(first.select(F.col("fp").alias("a"), F.col("rep").alias("ka")), "a").join(first.select(F.col("fp").alias("b"), F.col("rep").alias("kb")), "b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
        within = self.texts.join(first, "fp").where("near_key != rep").select(F.least("near_key", "rep").alias("a"), F.greatest("near_key", "rep").alias("b"))
        return self.verified(across.unionByName(within))

    def rooted(self, links: DataFrame) -> DataFrame:
        """(near_key, root) of the texts in links."""
        return self.held(components(links, "a", "b").select(F.col("node").alias("near_key"), "root"), "roots")

    def roots(self) -> DataFrame:
        """(near_key, root) of the texts with a link; root: one text of the group."""
        roots = self.rooted(self.close())
        marked = self.texts.join(roots, "near_key", "left").withColumn("root", F.coalesce("root", "near_key"))
        shared = self.held(map_batches(dealt_prefixes(marked, self.common[0]), prefix_edges(self.similarity), "a bigint, b bigint, family boolean").distinct(), "shared")
        self.freed()
        known = roots.where("near_key != root").select(F.col("near_key").alias("a"), F.col("root").alias("b"))
        links = known.unionByName(self.verified(shared.where("not family").select("a", "b")))
        roots = self.rooted(links)
        stars = shared.where("family")
        if stars.isEmpty():
            return roots
        families = self.held(components(stars, "a", "b").select(F.col("node").alias("near_key"), F.col("root").alias("family")), "families")
        members = families.join(roots, "near_key", "left").select("near_key", "family", F.coalesce("root", "near_key").alias("root"))
        several = members.groupBy("family").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("family")
        split = self.held(members.join(several, "family", "left_semi"), "split")
        if split.isEmpty():
            return roots
        sets = self.sets_of(split.select("near_key"))
        more = family_links(split.withColumnRenamed("near_key", "key"), sets, self.similarity)
        known = roots.where("near_key != root").select(F.col("near_key").alias("a"), F.col("root").alias("b"))
        roots = self.rooted(known.unionByName(more))
        drop_scratch(sets)
        return roots

    def grouped(self) -> tuple[DataFrame, DataFrame]:
        """(near_key, near_group, copies) of every text; (near_key, low) of the text and the smallest id that stand for each group."""
        grouped = scratch(self.texts.join(self.roots(), "near_key", "left").select("near_key", F.coalesce("root", "near_key").alias("near_group"), "low", "copies"), "grouped")
        for table in self.tables:
            drop_scratch(table)
        return grouped, grouped.groupBy("near_group").agg(F.min(F.struct("low", "near_key")).alias("at")).select("at.near_key", "at.low")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, max_bits: int = 3, similarity: float = 0.8, broadcast_keys: int = 1_000_000, salts: int = 64, key_bits: int = 64) -> DataFrame:
    """docs with `near_group` and `near_first`: groups of near-copies, whose row with the smallest id has near_first.

    A link is two texts with a Jaccard similarity of at least `similarity` over their sets of word shingles (a text of
    fewer words is one shingle), and groups are the components of all links.  Texts equal in 128 bits of hash are one text from
    the start (key_bits: the bits they are told apart by at first).
    Ids are integers; of equal smallest ids in a group the text with the smaller hash stands for it, and repeated rows
    of it all have near_first.  Null ids come last.  Null texts are a group of their own, as are blank ones.  Texts of any
    length take part whole.  Columns named near_... as here are replaced.  An empty table gives an empty result.
    """
    docs = docs.drop("near_key", "near_group", "near_first", "near_salt", "near_low")
    near = _Near(docs, id_col, text_col, shingle, max_bits, similarity, broadcast_keys, key_bits)
    grouped, best = near.grouped()
    chosen = grouped.join(best.select("near_key", F.col("low").alias("near_low")), "near_key", "left").select("near_key", "near_group", "copies", "near_low")
    # a text with over a thousandth of all rows is salted; there can be a thousand of them at most
    total = grouped.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = [r.near_key for r in grouped.where(F.col("copies") * 1000 > total).where("copies > 1000").select("near_key").collect()]
    is_hot = F.col("near_key").isin(hot) if hot else F.lit(False)
    salted = chosen.withColumn("near_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("copies")
    dealt = near.keyed.withColumn("near_salt", F.when(is_hot, F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    out = dealt.join(salted, ["near_key", "near_salt"])
    first = F.coalesce(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NONE)) == F.col("near_low"), F.lit(False))
    return out.withColumn("near_first", first).select(*docs.columns, "near_group", "near_first")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, max_bits: int = 3, similarity: float = 0.8, broadcast_keys: int = 1_000_000) -> DataFrame:
    """One row of each group of near_duplicates: the one with the smallest id, once if it is repeated.

    Rows are joined by text and id together, so copies of a text, however many, are spread over tasks.
    """
    own = docs.drop("near_key", "near_low")
    near = _Near(own, id_col, text_col, shingle, max_bits, similarity, broadcast_keys)
    _, best = near.grouped()
    keyed = near.keyed.withColumn("near_low", F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NONE)))
    kept = keyed.join(best.withColumnRenamed("low", "near_low"), ["near_key", "near_low"], "left_semi")
    return kept.dropDuplicates(["near_key", "near_low"]).select(*own.columns)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document.  Null, empty and blank texts share fingerprint 0; texts of any length
    count whole; equal and repeated rows share a component and all stay; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = classes(docs, shingle=3, max_bits=2)
    return out.select(F.col("id").alias("doc_id"), hex_fingerprint(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
