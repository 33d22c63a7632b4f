"""Similarity search, near-duplicate pairs, duplicate groups and clusters over embedding columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as c
from ..functions import vectors as v
from ..tables import drop_scratch, scratch, ship
from .graph import components, first_independent_set
from .ranking import ranked


def search(corpus: DataFrame, query: list[float], id_col: str, embedding: str, k: int = c.TOP_K) -> DataFrame:
    """The k rows most similar to one query vector: (id, similarity, rank).  The query is a literal, so this is a scan
    and a top-k, without a join."""
    if not query or k < 1:
        raise ValueError("a query vector and k >= 1 are needed")
    scored = corpus.select(id_col, v.dot(F.col(embedding), F.array(*[F.lit(float(x)) for x in query])).alias("similarity"))
    top = scored.orderBy(F.col("similarity").desc(), id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("similarity").desc(), id_col)))


def similar_to(corpus: DataFrame, example: object, id_col: str, embedding: str, k: int = c.TOP_K) -> DataFrame:
    row = corpus.where(F.col(id_col) == F.lit(example)).select(embedding).first()
    if row is None:
        raise ValueError(f"no row {example!r}")
    return search(corpus, list(row[0]), id_col, embedding, k)


def hash_tables(least: float, bits: int, recall: float) -> int:
    """How many tables of `bits` random directions find a pair at similarity `least` with probability `recall`."""
    share = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** bits
    return 1 if share >= recall else math.ceil(math.log1p(-recall) / math.log1p(-share))


def near_pairs(df: DataFrame, id_col: str, embedding: str, least: float = c.DUPLICATE_COSINE, method: str = "auto", block: int = 4096, bits: int = 16, recall: float = 0.999, exact_rows: int = 50_000, seed: int = 42) -> DataFrame:
    """(a, b, similarity) with a < b and dot product >= least; vectors are taken as normalised.

    exact: the theta join in blocks of at most about `block` rows, each pair of blocks one task-sized matrix product.
    lsh: candidates share the signs against `bits` random directions in one of as many tables as a pair at `least` needs
    to be found with probability `recall` (equi-joins only, and a recheck); pairs above are found more surely.
    auto: lsh for more than exact_rows rows if 64 tables are enough, else exact.
    """
    slim = df.select(F.col(id_col).alias("id"), F.col(embedding).alias("e")).where("id is not null and e is not null")
    kind = slim.schema["id"].dataType.simpleString()
    ship(df.sparkSession)
    tables = hash_tables(least, bits, recall)
    if method == "auto":
        method = "lsh" if tables <= 64 and slim.count() > exact_rows else "exact"
    if method == "lsh":
        size = slim.select(F.max(F.size("e"))).first()[0] or 1
        planes = np.random.default_rng(seed).normal(size=(tables, bits, size))

        def sign(batches):
            for pdf in batches:
                if len(pdf):
                    m = np.stack(pdf["e"].to_numpy()).astype(np.float64)
                    for t in range(tables):
                        key = ((m @ planes[t].T) > 0) @ (1 << np.arange(bits))
                        yield pd.DataFrame({"id": pdf["id"], "t": t, "key": key.astype(np.int64)})

        keys = slim.mapInPandas(sign, f"id {kind}, t int, key bigint")
        other = keys.withColumnRenamed("id", "b")
        pairs = keys.withColumnRenamed("id", "a").join(other, ["t", "key"]).where("a < b").select("a", "b").distinct()
        left, right = (slim.select(F.col("id").alias(k), F.col("e").alias(f"e{k}")) for k in "ab")
        return pairs.join(left, "a").join(right, "b").select("a", "b", v.dot(F.col("ea"), F.col("eb")).alias("similarity")).where(F.col("similarity") >= least)
    n = slim.count()
    blocks = max(1, math.ceil(n / block))
    placed = slim.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    dealt = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("id", "e", "k", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf["e"].to_numpy()).astype(np.float64)
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = np.flatnonzero(pdf["k"] == i), np.flatnonzero(pdf["k"] == j)
        ids, found = pdf["id"].to_numpy(), []
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            s = m[rows] @ m[right].T
            x, y = np.nonzero(s >= least)
            a, b = ids[rows[x]], ids[right[y]]
            keep = a < b if i == j else a != b
            found.append(pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "similarity": s[x, y][keep]}))
        return pd.concat(found) if found else pd.DataFrame({"a": [], "b": [], "similarity": []})

    return dealt.groupBy("i", "j").applyInPandas(compare, f"a {kind}, b {kind}, similarity double")


def duplicate_groups(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, is_source, source): greedy stars in order of id.  A source heads a group of its neighbours; source of
    a duplicate is its smallest one.  This is not the transitive closure: a neighbour's neighbours stay out."""
    both = scratch(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).union(pairs.select(b, a)).distinct(), "pairs")
    nodes = scratch(first_independent_set(both, "u", "v"), "nodes")
    heads = both.join(nodes.where("is_source").select(F.col("node").alias("v")), "v", "left_semi").groupBy("u").agg(F.min("v").alias("head"))
    return nodes.join(heads, nodes.node == heads.u, "left").select(F.col("node").alias("id"), "is_source", F.when(F.col("is_source"), F.col("node")).otherwise(F.col("head")).alias("source"))


def average_linkage(m: np.ndarray, most: float, sizes: np.ndarray | None = None) -> np.ndarray:
    """Flat labels (by first member) of average-linkage clusters of rows, cut at cosine distance `most`.  With sizes, rows are
    clusters of so many unit vectors already, and m has their sums.

    Chains of nearest neighbours end in pairs that are each other's nearest; those merge.  Of equally near pairs the one with
    the earlier rows comes first.  A pair further apart than `most` is final, as no later merge brings anything
    nearer.  Quadratic in the rows.
    """
    n = len(m)
    unit = m / (np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if sizes is None else sizes[:, None])
    d = 1 - unit @ unit.T
    d = (d + d.T) / 2
    np.fill_diagonal(d, np.inf)
    size, label, todo, chain = np.ones(n) if sizes is None else sizes.astype(np.float64), np.arange(n), np.ones(n, dtype=bool), []
    while todo.any() or chain:
        if not chain:
            chain = [int(todo.argmax())]
        i = chain[-1]
        j = int(d[i].argmin())
        if d[i, j] > most + 1e-12:  # nothing is near enough any more
            todo[i] = False
            chain.pop()
            continue
        if len(chain) < 2 or j != chain[-2]:
            chain.append(j)
            continue
        del chain[-2:]
        i, j = min(i, j), max(i, j)
        row = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        todo[j] = False
        label[label == j] = i
    return label


def sparse_linkage(total: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Flat labels (by first member) of average-linkage clusters, cut at cosine distance `most`, of rows that are clusters of so
    many unit vectors with these sums.  a, b: pairs of rows that hold every pair within `most`.

    By rounds, as in `merged_neighbours`.  A merge of others brings no cluster nearer, so what is within `most` of a
    merged cluster was so of one of its two: no other pairs ever come in.
    """
    total, sizes, label = total.astype(np.float64), sizes.astype(np.float64), np.arange(len(total))

    def measured(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        parts = [np.einsum("ij,ij->i", total[a[k : k + 65536]], total[b[k : k + 65536]]) for k in range(0, len(a), 65536)]
        return np.round(np.concatenate([np.zeros(0), *parts]) / (sizes[a] * sizes[b]), 12)

    a, b = np.minimum(a, b), np.maximum(a, b)
    near = measured(a, b)
    while len(a := a[keep := near >= 1 - most - 1e-12]):
        b, near = b[keep], near[keep]
        order = np.lexsort((b, a, -near))
        a, b, near = a[order], b[order], near[order]
        first, place = np.full(len(total), len(a)), np.arange(len(a))
        np.minimum.at(first, a, place)
        np.minimum.at(first, b, place)
        both = (first[a] == place) & (first[b] == place)
        x, y = a[both], b[both]
        total[x] += total[y]
        sizes[x] += sizes[y]
        label[y] = x
        head, moved = np.arange(len(total)), np.zeros(len(total), dtype=bool)
        head[y], moved[x] = x, True
        a, b = head[a], head[b]
        a, b = np.minimum(a, b), np.maximum(a, b)
        _, one = np.unique(a * len(total) + b, return_index=True)
        one = one[a[one] != b[one]]
        a, b, near = a[one], b[one], near[one]
        new = moved[a] | moved[b]
        near[new] = measured(a[new], b[new])
    while (label[label] != label).any():
        label = label[label]
    return label


def _centres(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean vectors, the same in single precision, how far a cosine of the latter may be off); means are no longer than 1."""
    m = np.stack(pdf["total"].to_numpy()) / pdf["n"].to_numpy()[:, None]
    return m, m.astype(np.float32), (m.shape[1] + 4) * 2.0**-23


def near_clusters(sums: DataFrame, most: float, block: int = 8192) -> DataFrame:
    """(a, b) of all clusters of sums (id, n, total) with a mean cosine of at least 1 - most, a < b; some a rounding error below
    it are among them."""
    kind = sums.schema["id"].dataType.simpleString()
    blocks = max(1, math.ceil(sums.count() / block))
    placed = sums.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    dealt = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("id", "n", "total", "k", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"))
    ship(sums.sparkSession)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        m, m32, slack = _centres(pdf)
        ids, i, j = pdf["id"].to_numpy(), pdf["i"].iloc[0], pdf["j"].iloc[0]
        good = np.isfinite(m).all(axis=1)
        left, right = (np.flatnonzero((pdf["k"] == k).to_numpy() & good) for k in (i, j))
        found = [pd.DataFrame({"a": ids[:0], "b": ids[:0]})]
        for k in range(0, len(left), 512):
            rows = left[k : k + 512]
            x, y = np.nonzero(m32[rows] @ m32[right].T >= 1 - most - slack)
            a, b = ids[rows[x]], ids[right[y]]
            keep = a < b if i == j else a != b
            found.append(pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]}))
        return pd.concat(found)

    return dealt.groupBy("i", "j").applyInPandas(compare, f"a {kind}, b {kind}")


def nearest_clusters(sums: DataFrame, todo: DataFrame, most: float, block: int = 8192) -> DataFrame:
    """(lo, hi, near, id, others): of each cluster in todo (id) the nearest one of sums (id, n, total: size and vector sum), if its
    mean cosine near is at least 1 - most, and how many are that near, at most.  Equally near: the smaller id.

    Clusters are dealt into blocks of about `block` rows; each pair of blocks is a matrix product, of which one row a
    cluster leaves.  So a round needs no table of pairs, however dense they are.  The product is in single precision; what its
    error leaves open is measured in double.
    """
    kind = sums.schema["id"].dataType.simpleString()
    asked = sums.join(todo, "id", "left_semi")
    x, y = (max(1, math.ceil(df.count() / block)) for df in (todo, sums))
    at = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = asked.select("id", "n", "total", at(x).alias("i"), each(y).alias("j"), F.lit(True).alias("asks"))
    right = sums.select("id", "n", "total", each(x).alias("i"), at(y).alias("j"), F.lit(False).alias("asks"))
    ship(sums.sparkSession)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        (m, m32, slack), asks, ids, found = _centres(pdf), pdf["asks"].to_numpy(), pdf["id"].to_numpy(), []
        good = np.isfinite(m).all(axis=1)
        rows, others = np.flatnonzero(asks & good), np.flatnonzero(~asks & good)
        place = {k: p for p, k in enumerate(ids[others].tolist())}
        for k in range(0, len(rows) if len(others) else 0, 512):
            some = rows[k : k + 512]
            s = m32[some] @ m32[others].T
            own = np.array([place.get(v, -1) for v in ids[some].tolist()])
            s[np.flatnonzero(own >= 0), own[own >= 0]] = -np.inf
            count = (s >= 1 - most - slack).sum(axis=1)
            may = s >= np.maximum(s.max(axis=1) - 3 * slack, 1 - most - slack)[:, None]
            width = may.sum(axis=1)
            top, best = np.full(len(some), -np.inf), np.zeros(len(some), dtype=np.int64)
            many = np.flatnonzero(width > 64)  # copies of one vector: their whole rows again
            if len(many):
                t = m[some[many]] @ m[others].T
                back = own[many]
                t[np.flatnonzero(back >= 0), back[back >= 0]] = -np.inf
                top[many] = t.max(axis=1)
                best[many] = (t >= top[many][:, None] - 1e-12).argmax(axis=1)  # of equal ones the first
                may[many] = False
            x, y = np.nonzero(may)
            if len(x):
                exact = np.einsum("ij,ij->i", m[some[x]], m[others[y]])
                np.maximum.at(top, x, exact)
                good = np.flatnonzero(exact >= top[x] - 1e-12)[::-1]
                best[x[good]] = y[good]  # the first is written last
            near = top >= 1 - most - 1e-12
            a, b = ids[some][near], ids[others[best]][near]
            found.append(pd.DataFrame({"id": a, "lo": np.minimum(a, b), "hi": np.maximum(a, b), "near": np.round(top[near], 12), "others": count[near]}))
        return pd.concat(found) if found else pd.DataFrame({"id": [], "lo": [], "hi": [], "near": [], "others": []})

    dealt = left.unionByName(right).repartition(min(x * y, 64), "i", "j")
    found = dealt.groupBy("i", "j").applyInPandas(compare, f"id {kind}, lo {kind}, hi {kind}, near double, others bigint")
    best = found.groupBy("id").agg(F.min(F.struct((-F.col("near")).alias("far"), "lo", "hi")).alias("best"), F.sum("others").alias("others"))
    return best.select("best.lo", "best.hi", (-F.col("best.far")).alias("near"), "id", "others")


def merged_neighbours(points: DataFrame, most: float, task_rows: int, task_pairs: int = 1_000_000, task_values: int = 1 << 22) -> DataFrame:
    """(id, head) of the points (id, e: unit vectors) that average linkage, cut at cosine distance `most`, puts under another
    one; head is the cluster's smallest id.

    Each round merges all pairs of clusters that are each other's nearest and within `most`; average linkage allows that in any
    order, and of equally near pairs the one with the smaller ids counts as nearer, so the nearest pair of all always
    merges.  The mean cosine of two clusters is the product of their vector sums over the product of their sizes, so no
    members meet in a task.  A merge of others never brings a cluster nearer: one without a neighbour within `most` is final and
    leaves, and only clusters that merged, or whose nearest did, look for their nearest again.  Once at most
    `task_rows` clusters are left, one task merges them; so it does once at most `task_pairs` pairs are within `most` and the
    vector sums have at most `task_values` numbers, which is long before, as most clusters then have a few near ones.
    """
    kind = points.schema["id"].dataType.simpleString()
    # copies of a vector are one cluster from the start: as all of them are nearest to the first, rounds would merge one at a time
    wide = points.select("id", F.col("e").cast("array<double>").alias("e"))
    alone = F.when(~F.coalesce(v.dot(F.col("e"), F.col("e")).between(0.5, 2.0), F.lit(False)) | F.lit(most < 0), F.col("id"))
    groups = scratch(wide.groupBy("e", alone.alias("alone")).agg(F.min("id").alias("id"), F.count("*").alias("n")), "groups")
    sums = scratch(groups.select("id", "n", F.transform("e", lambda x: x * F.col("n")).alias("total")), "sums")
    copies = wide.join(groups.where("n > 1 and alone is null").select("e", F.col("id").alias("lo")), "e").where("id != lo").select(F.col("id").alias("hi"), "lo")
    todo, known, moves = sums.select("id"), None, [scratch(copies, "copies")]
    drop_scratch(groups)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[[np.isfinite(x).all() for x in pdf["total"]]].sort_values("id")
        if not len(pdf):
            return pd.DataFrame({"hi": [], "lo": []})
        ids = pdf["id"].to_numpy()
        head = ids[average_linkage(np.stack(pdf["total"].to_numpy()), most, pdf["n"].to_numpy())]
        return pd.DataFrame({"hi": ids, "lo": head})[ids != head]

    def link_pairs(pdf: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids = pdf["id"].to_numpy()
        a, b = (np.searchsorted(ids, pairs[k].to_numpy()) for k in "ab")
        head = ids[sparse_linkage(np.stack(pdf["total"].to_numpy()), pdf["n"].to_numpy(), a, b, most)] if len(ids) else ids
        return pd.DataFrame({"hi": ids, "lo": head})[ids != head]

    ship(points.sparkSession)
    size = points.select(F.max(F.size("e"))).first()[0] or 1
    few = False
    while (n := sums.count()) > max(1, task_rows):
        found = nearest_clusters(sums, todo, most)
        wanted = scratch(found.unionByName(known) if known is not None else found, "wanted")
        best = wanted.select(F.explode(F.array("lo", "hi")).alias("end"), F.struct((-F.col("near")).alias("far"), "lo", "hi").alias("best")).groupBy("end").agg(F.min("best").alias("best"))
        merged = scratch(best.groupBy("best.lo", "best.hi").agg(F.count("*").alias("k")).where("k = 2").select("lo", "hi"), "merged")
        if merged.isEmpty():
            n = 0
            break
        moves.append(merged)
        gone = merged.select(F.explode(F.array("lo", "hi")).alias("id"))
        kept = sums.join(wanted.select(F.explode(F.array("lo", "hi")).alias("id")).distinct(), "id", "left_semi").join(gone, "id", "left_anti")
        pair = merged.join(sums.select(F.col("id").alias("lo"), F.col("n").alias("n1"), F.col("total").alias("t1")), "lo").join(sums.select(F.col("id").alias("hi"), F.col("n").alias("n2"), F.col("total").alias("t2")), "hi")
        new = scratch(kept.unionByName(pair.select(F.col("lo").alias("id"), (F.col("n1") + F.col("n2")).alias("n"), F.zip_with("t1", "t2", lambda x, y: x + y).alias("total"))), "sums")
        stays = wanted
        for k in ("lo", "hi"):
            stays = stays.join(gone.withColumnRenamed("id", k), k, "left_anti")
        still = scratch(stays.select("lo", "hi", "near", "id", "others"), "known")
        # a merge makes no pair that was not within `most` before, so there are at most so many now
        few = wanted.agg(F.coalesce(F.sum("others"), F.lit(0))).first()[0] <= 2 * task_pairs and new.count() * size <= task_values
        for done in (sums, wanted, *([known] if known is not None else [])):
            drop_scratch(done)
        sums, known = new, still
        todo = sums.select("id").join(known.select("id"), "id", "left_anti")
        if few:
            break
    if few:
        one = F.lit(0).alias("g")
        alike = scratch(near_clusters(sums, most), "alike")
        ends = alike.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        left, right = sums.join(ends, "id", "left_semi").select("*", one).groupBy("g"), alike.select("*", one).groupBy("g")
        moves.append(scratch(left.cogroup(right).applyInPandas(link_pairs, f"hi {kind}, lo {kind}").select("lo", "hi"), "last"))
        drop_scratch(alike)
    elif n > 1:
        moves.append(scratch(sums.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(link, f"hi {kind}, lo {kind}").select("lo", "hi"), "last"))
    every = moves[0]
    for one in moves[1:]:
        every = every.unionByName(one)
    return components(every, "hi", "lo").select(F.col("node").alias("id"), F.col("root").alias("head"))


def clusters(df: DataFrame, id_col: str, embedding: str, most: float, task_rows: int = 4096) -> DataFrame:
    """(id, cluster, cluster_size): average linkage over cosine distance, cut at `most`; clusters are numbered by
    their smallest id.  Rows without an embedding are dropped.

    Over `task_rows` rows are linked by rounds of nearest neighbours (`merged_neighbours`), what is left then in one task.
    """
    slim = scratch(df.select(F.col(id_col).alias("id"), v.unit(F.col(embedding)).alias("e")).where("e is not null"), "unit")
    linked = merged_neighbours(slim, most, task_rows)
    heads = scratch(slim.select("id").join(linked, "id", "left").select("id", F.coalesce("head", "id").alias("head")), "heads")
    drop_scratch(slim)
    sizes = heads.groupBy("head").agg(F.count("*").alias("cluster_size"))
    numbered = ranked(sizes, ["head"], "cluster")
    return heads.join(numbered, "head").select("id", "cluster", "cluster_size")


def cache_is_valid(cached: DataFrame, live: DataFrame, model_id: str) -> bool:
    """Whether an embedding table (path, embedding, model_id, built_at) still serves live files (path, modified)."""
    models = [r[0] for r in cached.select("model_id").distinct().limit(2).collect()]
    if models != [model_id]:
        return False
    stale = live.join(cached, "path", "full_outer").where("embedding is null or modified is null or modified > built_at")
    return stale.isEmpty() and cached.count() == live.count()


def usable_cache(cached: DataFrame | None, model_id: str) -> DataFrame | None:
    """An embedding table (path, embedding, model_id), if a run may use it: made by that model alone, with rows, and all
    embeddings of one size over 0; else None."""
    if cached is None:
        return None
    found = cached.agg(F.count("*").alias("n"), F.count_if(~F.col("model_id").eqNullSafe(F.lit(model_id))).alias("other"), F.min(F.coalesce(F.size("embedding"), F.lit(0))).alias("least"), F.max(F.coalesce(F.size("embedding"), F.lit(0))).alias("most")).first()
    return cached if found.n and not found.other and 0 < found.least == found.most else None


def gather_all(cached: DataFrame | None, wanted: DataFrame) -> DataFrame | None:
    """The embeddings (path, embedding) of all wanted paths, or None if the cache lacks any."""
    if cached is None or not wanted.join(cached, "path", "left_anti").isEmpty():
        return None
    return cached.join(wanted.select("path").distinct(), "path", "left_semi").select("path", "embedding")
