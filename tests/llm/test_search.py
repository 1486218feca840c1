"""Vantage-point trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone.llm import vptree


def _nearest(ids, points, query, k):
    distance = np.sqrt(((points - points[query]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, distance)) if i != query][:k]
    return [(int(ids[i]), float(distance[i])) for i in order]


@pytest.mark.parametrize("shape", ["spread", "clusters", "grid", "equal"])
def test_factor_one_is_exact(shape):
    rng = np.random.default_rng(5)
    points = {
        "spread": rng.normal(size=(900, 12)),
        "clusters": rng.normal(size=(9, 3))[rng.integers(0, 9, 900)] * 50 + rng.normal(size=(900, 3)),
        "grid": rng.integers(0, 3, (900, 3)).astype(float),
        "equal": np.ones((900, 4)),
    }[shape]
    ids = rng.permutation(5000)[:900].astype(np.int64)
    tree = vptree.Tree(ids, points, leaf=16)
    distances, found = tree.search(ids[::30], points[::30], 10)
    for at, query in enumerate(range(0, 900, 30)):
        want = _nearest(ids, points, query, 10)
        assert found[at].tolist() == [i for i, _ in want]
        assert distances[at].tolist() == pytest.approx([d for _, d in want], rel=1e-14)


def test_larger_factors_look_at_fewer_vectors_of_clustered_data(monkeypatch):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(40, 6))[rng.integers(0, 40, 4000)] * 20 + rng.normal(size=(4000, 6))
    ids = np.arange(4000)
    looked = []
    offer = vptree.Tree._offer
    monkeypatch.setattr(vptree.Tree, "_offer", lambda self, a, f, t: (looked.append(len(a) * (t - f)), offer(self, a, f, t))[1])
    tree, seen, found = vptree.Tree(ids, points), [], []
    for factor in (1.0, 3.0):
        looked.clear()
        found.append(tree.search(ids[::40], points[::40], 10, factor)[1])
        seen.append(sum(looked))
    assert seen[1] < seen[0] < 0.5 * 4000 * 100
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(*[f.tolist() for f in found])])
    assert recall >= 0.9


def test_search_over_shards_and_waves(spark):
    rng = np.random.default_rng(9)
    points = rng.integers(-2, 3, (400, 3)).astype(float)
    rows = [(i, p.tolist()) for i, p in enumerate(points) if any(p)]
    ids, points = np.array([i for i, _ in rows]), np.array([p for _, p in rows])
    odd = [(1000, None), (1100, [0.0] * 3), (1200, [1.0, float("nan"), 1.0]), (1300, [1.0, None, 1.0]), (None, [1.0] * 3), (1400, [1.0, 1.0]), (1500, [])]
    table = spark.createDataFrame([(*r, 0, "x") for r in rows + rows[:4] + odd], "vec_id long, embedding array<float>, score int, shard string")
    found = vptree.nearest(table, F.col("id") % 10 == 0, shard_rows=60, wave_rows=9).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert set(got) == {i for i in ids.tolist() if i % 10 == 0}  # 1400 has no candidate of its length
    for query, neighbours in got.items():
        want = _nearest(ids, points, int(np.flatnonzero(ids == query)[0]), 10)
        assert [i for i, _ in neighbours] == [i for i, _ in want]
        assert [s for _, s in neighbours] == pytest.approx([s for _, s in want], rel=1e-14)


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [3.0]), (10, [2.0])], "vec_id long, embedding array<double>")
    found = vptree.nearest(few, F.col("id") % 10 == 0).collect()
    assert sorted(tuple(r) for r in found) == [(0, 1, 10, 1.0), (0, 2, 1, 2.0), (10, 1, 0, 1.0), (10, 2, 1, 1.0)]
    assert vptree.nearest(few.limit(0), F.lit(True)).count() == 0
