"""Greedy sets and clusters against plain Python, with blocks so small that decisions cross them."""

import random

import numpy as np
import pytest

from winnow.operators import graph, similarity


def greedy(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for n in sorted(near):
        out[n] = not any(out.get(m, False) for m in near[n] if m < n)
    return out


def taken(df):
    rows = df.collect()
    out = {r.node: r.is_source for r in rows}
    assert len(out) == len(rows)
    return out


def jobs(spark, work):
    """(what work returns, the number of Spark jobs it ran)."""
    tracker, group = spark.sparkContext.statusTracker(), f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        return work(), len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_long_path_in_order_of_id_takes_few_jobs(spark):
    edges = spark.range(99_999).selectExpr("id as a", "id + 1 as b")
    got, ran = jobs(spark, lambda: graph.first_independent_set(edges, "a", "b", block_rows=100_000).groupBy("is_source").count().collect())
    assert {r.is_source: r["count"] for r in got} == {True: 50_000, False: 50_000}
    assert ran < 20


def test_a_path_of_10000_ids_over_blocks_equals_plain_python(spark):
    edges = [(k, k + 1) for k in range(9_999)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert taken(graph.first_independent_set(df, "a", "b", block_rows=6_000)) == greedy(edges)


@pytest.mark.parametrize("seed, block", [(1, 50), (2, 200), (3, 1 << 20)])
def test_random_graphs_equal_plain_python(spark, seed, block):
    r = random.Random(seed)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(260)] + [(7, k) for k in range(150)] + [(3, 3), (None, 4), (5, None)]
    edges += edges[:20] + [(b, a) for a, b in edges[20:40]]
    df = spark.createDataFrame(edges, "a int, b int").repartition(3)
    assert taken(graph.first_independent_set(df, "a", "b", block_rows=block)) == greedy(edges)


def test_names_as_ids_and_no_edges(spark):
    edges = [(f"n{k}", f"n{k * 7 % 40}") for k in range(40)]
    assert taken(graph.first_independent_set(spark.createDataFrame(edges, "a string, b string"), "a", "b", block_rows=30)) == greedy(edges)
    assert graph.first_independent_set(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_groups_of_a_chain_name_the_smallest_head(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(600)], "a long, b long")
    got = {r.id: (r.is_source, r.source) for r in similarity.duplicate_groups(pairs).collect()}
    assert got == {k: (k % 2 == 0, k - k % 2) for k in range(601)}


# ---------------------------------------------------------------- average linkage


def plain_linkage(points, most):
    """Heads by id: the nearest two clusters merge until none are within `most`; of equal ones those with the smaller ids."""
    groups = {k: [k] for k in points}
    while True:
        best = None
        for a in sorted(groups):
            for b in sorted(groups):
                if a < b:
                    near = float(np.mean([[points[i] @ points[j] for j in groups[b]] for i in groups[a]]))
                    if 1 - near <= most + 1e-12 and (best is None or (round(-near, 9), a, b) < best):
                        best = round(-near, 9), a, b
        if best is None:
            return {i: a for a, g in groups.items() for i in g}
        groups[best[1]] += groups.pop(best[2])


def cloud(seed, n, around, noise):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(around, 5))
    x = centres[r.integers(0, around, n)] + noise * r.normal(size=(n, 5))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def partition(found):
    groups = {}
    for i, c in found.items():
        groups.setdefault(c, set()).add(i)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("seed, noise, most", [(1, 0.3, 0.15), (3, 1.5, 0.6)])
def test_linkage_by_joins_and_in_tasks_equals_plain_merging(spark, seed, noise, most):
    x = cloud(seed, 36, 6, noise)
    x = np.vstack([x, x[:4], x[:1]])  # copies
    df = spark.createDataFrame([(k * 3, e.tolist()) for k, e in enumerate(x)] + [(999, None)], "id long, e array<double>")
    want = partition(plain_linkage({k * 3: e for k, e in enumerate(x)}, most))
    for task_rows in (4096, 1):
        rows = similarity.clusters(df, "id", "e", most, task_rows=task_rows).collect()
        assert partition({r.id: r.cluster for r in rows}) == want
        heads = sorted({(r.cluster, min(q.id for q in rows if q.cluster == r.cluster), r.cluster_size) for r in rows})
        assert [h[0] for h in heads] == list(range(len(want))) and [h[1] for h in heads] == sorted(g[0] for g in want)
        assert {h[1]: h[2] for h in heads} == {g[0]: len(g) for g in want}


def test_a_large_component_is_linked_by_joins(spark):
    """A chain of tight knots at uneven steps: one component of 320 rows, no part of which meets in a task."""
    r = np.random.default_rng(4)
    at = np.repeat(np.cumsum(r.uniform(0.01, 0.03, 40)), 8) + r.uniform(0, 1e-4, 320)
    x = np.stack([np.cos(at), np.sin(at)], axis=1)
    df = spark.createDataFrame([(k, e.tolist()) for k, e in enumerate(x)], "id long, e array<double>")
    most = float(1 - np.cos(0.031))
    rows = similarity.clusters(df, "id", "e", most, task_rows=100).collect()
    label = similarity.average_linkage(x, most)
    assert len(set(label.tolist())) < 40
    assert partition({r.id: r.cluster for r in rows}) == partition(dict(enumerate(label.tolist())))
