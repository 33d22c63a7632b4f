"""Average linkage of more rows than one task takes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.operators import select, similarity


@pytest.mark.parametrize("block", [8192, 7])
def test_a_dense_table_is_linked_without_its_pairs(spark, monkeypatch, block):
    """Rounds of nearest neighbours, in one block or in many, equal linkage in one task; no table of pairs is made."""
    r = np.random.default_rng(8)
    x = r.normal(size=(12, 6))[r.integers(0, 12, 150)] + 0.4 * r.normal(size=(150, 6))
    x = np.vstack([x, x[:20], np.zeros((1, 6)), np.full((1, 6), np.nan)])
    nearest = similarity.nearest_clusters
    monkeypatch.setattr(similarity, "nearest_clusters", lambda sums, todo, most: nearest(sums, todo, most, block))
    monkeypatch.setattr(similarity, "near_pairs", None)
    df = spark.createDataFrame([(k, e.tolist()) for k, e in enumerate(x)], "id long, e array<double>")
    got = {q.id: q.cluster for q in similarity.clusters(df, "id", "e", 0.3, task_rows=20).collect()}
    label = np.append(similarity.average_linkage(x[:-1], 0.3), len(x) - 1)
    head = {c: min(i for i in got if got[i] == c) for c in set(got.values())}
    assert [head[got[i]] for i in range(len(x))] == label.tolist() and 10 < len(head) < 60


def test_curation_makes_no_table_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "near_pairs", None)
    x = np.repeat(np.eye(3), 10, axis=0) + 0.01 * np.random.default_rng(2).normal(size=(30, 3))
    df = spark.createDataFrame([(k, float(k % 10), e.tolist()) for k, e in enumerate(x)], "id long, score double, e array<double>")
    df = df.withColumns({"has_face": F.lit(False), "is_motion": F.lit(False), "shapes": F.lit(None).cast("map<string,double>"), "motion": F.lit(0.0)})
    rows = select.curate(df, "id", "score", "e", 5, 0.5).orderBy("place").collect()
    assert [(r.id, r.cluster, r.cluster_size) for r in rows] == [(9, 0, 10), (19, 1, 10), (29, 2, 10)]


@pytest.mark.parametrize("limits", [{"task_pairs": 0}, {}])
def test_rounds_and_one_task_over_near_pairs_give_the_same(spark, monkeypatch, limits):
    """Rounds to their end, and the pairs of what one round leaves in one task, equal linkage of the whole matrix."""
    r = np.random.default_rng(3)
    x = np.vstack([r.normal(size=(15, 8))[r.integers(0, 15, 90)] + 0.5 * r.normal(size=(90, 8)), np.tile(r.normal(size=8), (70, 1)), np.zeros((1, 8))])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    df = spark.createDataFrame([(k, e.tolist()) for k, e in enumerate(x)], "id long, e array<double>")
    asked, nearest = [], similarity.nearest_clusters
    monkeypatch.setattr(similarity, "nearest_clusters", lambda *a: asked.append(1) or nearest(*a))
    found = {q.id: q.head for q in similarity.merged_neighbours(df, 0.4, 50, **limits).collect()}
    label = similarity.average_linkage(x, 0.4)
    assert [found.get(k, k) for k in range(len(x))] == label.tolist() and 10 < len(set(label)) < 90
    assert 1 < len(asked) < 20 if limits else len(asked) == 1  # a round for each copy would be 70 more


def test_near_pairs_alone_give_the_linkage_of_the_matrix():
    r = np.random.default_rng(5)
    x = r.normal(size=(20, 6))[r.integers(0, 20, 300)] + 0.6 * r.normal(size=(300, 6))
    x = np.vstack([x, x[:30]]) / np.linalg.norm(np.vstack([x, x[:30]]), axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.5 - 1e-9, 1))
    got = similarity.sparse_linkage(x, np.ones(len(x)), a, b, 0.5)
    assert got.tolist() == similarity.average_linkage(x, 0.5).tolist()
    assert similarity.sparse_linkage(x[:2], np.ones(2), a[:0], b[:0], 0.5).tolist() == [0, 1]
