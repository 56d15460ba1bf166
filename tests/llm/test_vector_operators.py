"""Vector operators against brute force and odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowgraph.llm import ann, embedding_dedup

ODD = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] * 8]


def table(spark, vectors, start=0):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 1.5) for i, v in enumerate(vectors, start)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")


def groups(seed=3):
    rng = np.random.default_rng(seed)
    x = list(rng.standard_normal((150, 8)))
    for k in range(10):
        x += [x[k] + 0.12 * rng.standard_normal(8) for _ in range(12)]
    return x + [x[0], x[0], 2 * x[1]]


@pytest.mark.parametrize("block", [1024, 4])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    vectors = groups()
    x = np.array(vectors)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    close = unit @ unit.T >= 0.9
    parent = list(range(len(x)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(close)):
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    found = {r["vec_id"]: r for r in embedding_dedup.near_vectors(table(spark, vectors + ODD)).collect()}
    n = len(vectors)
    assert [found[i]["n_links"] for i in range(n)] == (close.sum(1) - 1).tolist()
    assert [found[i]["component_id"] for i in range(n)] == [root(i) for i in range(n)]
    for i in range(n, n + len(ODD)):
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (0, i, True)


def test_no_vectors(spark):
    empty = table(spark, ODD).limit(0)
    assert embedding_dedup.near_vectors(empty).count() == 0
    assert ann.nearest(empty, F.col("vec_id") % 2 == 0).count() == 0
    assert ann.nearest(table(spark, ODD), F.lit(True)).count() == 0


def exact(x, queries, k):
    out = {}
    for q in queries:
        score = x @ x[q]
        score[q] = -np.inf
        out[q] = np.lexsort((np.arange(len(x)), -score))[:k].tolist()
    return out


def test_small_tables_are_exact_with_ties(spark):
    x = np.round(np.random.default_rng(5).standard_normal((60, 8)), 1)
    x[10:14] = x[9]
    found = ann.nearest(table(spark, list(x) + ODD), F.col("vec_id") % 5 == 0, k=7, exact=True).orderBy("query_id", "rank").collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]))
    assert got == exact(x, range(0, 60, 5), 7)
    few = ann.nearest(table(spark, list(x[:4])), F.col("vec_id") == 0, k=20).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3]


def test_recall_on_unclustered_vectors(spark):
    x = np.random.default_rng(6).standard_normal((3000, 32))
    found = ann.nearest(table(spark, list(x)), F.col("vec_id") % 50 == 0, k=10).collect()
    want = exact(x, range(0, 3000, 50), 10)
    assert len(found) == 600
    assert sum(r["vec_id"] in want[r["query_id"]] for r in found) / 600 >= 0.9


@pytest.mark.parametrize("copies", [1, 4])
def test_recall_on_clusters_and_copies(spark, copies):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((40, 64))
    base = centres[rng.integers(0, 40, 4500 // copies)] + 0.5 * rng.standard_normal((4500 // copies, 64))
    x = np.repeat(base, copies, axis=0) + 0.02 * rng.standard_normal((4500 // copies * copies, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = ann.nearest(table(spark, list(x)), F.col("vec_id") % 30 == 0).collect()
    want = exact(x, range(0, len(x), 30), 20)
    assert len(found) == 20 * len(want)
    assert sum(r["vec_id"] in want[r["query_id"]] for r in found) / len(found) >= 0.99
