"""Operators on embeddings against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from billweave.llm import neighbours, subspace
from billweave.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, v string, score double"


def table(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], v, 0, 1, "clash", 0.5) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def cloud(n=400, dims=24, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x[100:160] = x[100] + rng.normal(scale=0.15, size=(60, dims))  # a group of near copies
    x[200:230] = x[200]  # a group of copies
    x[300] = 3 * x[301]
    return [[float(c) for c in v] for v in x.astype("f4")]


BAD = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0] * 7]


def unit(vectors):
    x = np.array(vectors, float)
    return x / np.sqrt((x * x).sum(1))[:, None]


@pytest.mark.parametrize("chunk", [8192, 37])
def test_near_duplicates(spark, chunk):
    good = cloud()
    rows = subspace.near_duplicates(table(spark, good + BAD), 0.9, chunk=chunk).collect()
    got = {r["vec_id"]: r for r in rows}
    assert len(rows) == len(good) + len(BAD)
    near = unit(good) @ unit(good).T >= 0.9
    np.fill_diagonal(near, False)
    parent = np.arange(len(good))
    for _ in range(len(good)):
        step = np.array([min([parent[i], *parent[near[i]]]) for i in range(len(good))])
        if (step == parent).all():
            break
        parent = step
    for i in range(len(good)):
        assert got[i]["n_links"] == near[i].sum()
        assert got[i]["component_id"] == parent[i] and got[i]["kept"] == (parent[i] == i)
    for i in range(len(good), len(rows)):
        assert tuple(got[i])[1:] == (0, i, True)


def test_near_duplicates_of_repeated_rows_and_nothing(spark):
    rows = subspace.near_duplicates(table(spark, [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]], [5, 5, 7])).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in rows) == [(5, 1, 5), (5, 1, 5), (7, 0, 7)]
    assert subspace.near_duplicates(table(spark, [])).count() == 0
    assert [r["kept"] for r in subspace.near_duplicates(table(spark, [None])).collect()] == [True]


def test_pieces_meet_without_copies_in_a_shuffle(spark, monkeypatch):
    plans, checkpoint = [], subspace.checkpoint

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpoint(df)

    monkeypatch.setattr(subspace, "checkpoint", noted)
    assert subspace.near_duplicates(table(spark, cloud()), 0.9, chunk=37).count() == 400
    assert "CartesianProduct" in plans[-1] and "Exchange" not in plans[-1]


@pytest.mark.parametrize("dims", [1, 3, 8, 20])
def test_near_duplicates_in_other_dimensions(spark, dims):
    x = unit(np.random.default_rng(dims).normal(size=(150, dims)))
    rows = subspace.near_duplicates(table(spark, x.tolist()), 0.8).collect()
    y = unit(x.astype("f4"))
    want = (y @ y.T >= 0.8).sum(1) - 1
    assert [r["n_links"] for r in sorted(rows)] == want.tolist()


def plain_search(vectors, queries, k):
    x = unit(vectors)
    near = {}
    for q in queries:
        s = x @ x[q]
        order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-round(float(s[i]), 12), i))
        near[q] = order[:k]
    return near


@pytest.mark.parametrize("chunk", [8192, 50])
def test_search(spark, chunk):
    good = cloud(600)
    settings = neighbours.Index(list_rows=60, chunk=chunk)
    rows = neighbours.search(table(spark, good + BAD), F.col("vec_id") % 10 == 0, 5, settings).collect()
    want = plain_search(good, range(0, 600, 10), 5)
    got = {q: [r["vec_id"] for r in sorted(rows) if r["query_id"] == q] for q in want}
    assert all(len(v) == 5 for v in got.values()) and len(rows) == 5 * len(want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / (5 * len(want)) >= 0.9
    assert got[210] == [200, 201, 202, 203, 204]  # ties go to smaller ids
    x = unit(good)
    for r in rows:
        assert abs(r["score"] - x[r["query_id"]] @ x[r["vec_id"]]) < 1e-12


def test_search_of_few_rows(spark):
    rows = neighbours.search(table(spark, [[1.0, 0.0], [0.0, 1.0], None], [0, 1, 2]), F.col("vec_id") == 0, 5).collect()
    assert [tuple(r) for r in rows] == [(0, 1, 1, 0.0)]
    assert neighbours.search(table(spark, []), F.lit(True), 5).count() == 0
    assert neighbours.search(table(spark, BAD[:4]), F.lit(True), 5).count() == 0


def test_every_vector_is_indexed_and_the_graph_is_exact_enough():
    rng = np.random.default_rng(1)
    x = unit(rng.normal(size=(3000, 16)))
    centres = neighbours.centroids(x, 60, 1)
    graph = neighbours.Graph(centres, 16)
    row, lists = graph.within(x, 1.1)
    assert set(row) == set(range(len(x)))
    gaps = np.sqrt(np.maximum(2 - 2 * x @ centres.T, 0))
    want = set(zip(*np.nonzero(gaps <= 1.1 * gaps.min(1, keepdims=True))))
    assert len(want & set(zip(row, lists))) / len(want) > 0.98


def test_components_of_a_chain_a_star_and_noise(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(10, 60)] + [(7, 7), (70, 69), (69, 70)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in [5, *range(10, 60)]}, 69: 69, 70: 69}
