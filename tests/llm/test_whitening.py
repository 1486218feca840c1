"""Whitening against exact fractions and a plain eigendecomposition."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from rillstone.llm import queries, whitening
from tests.llm.test_corpus import FOLDER, tables

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def _held_against_fractions(rows, found, components=8):
    """`rows` are (id, vector) that take part; ids are unique."""
    x = {i: [math.floor(1024 * float(c)) + 100_000 for c in v] for i, v in rows}
    n, dims = len(x), len(next(iter(x.values())))
    sums = [sum(v[d] for v in x.values()) for d in range(dims)]
    covariance = np.array(
        [[float(Fraction(n * sum(v[i] * v[j] for v in x.values()) - sums[i] * sums[j], n * n)) for j in range(dims)] for i in range(dims)]
    )
    values = np.linalg.eigvalsh(covariance)[::-1]
    by_component = {}
    assert len(found) == n * min(components, dims)
    for r in found:
        by_component.setdefault(r["component"], {})[r["vec_id"]] = r["whitened"]
        assert r["n"] == n and r["identity_error"] <= 1e-9
        assert r["deviation"] == sum((n * v - s) ** 2 for v, s in zip(x[r["vec_id"]], sums))
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(covariance), rel=1e-9)
    ids = sorted(x)
    centred = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(x[i], sums)] for i in ids])
    for k, of in by_component.items():
        column = np.array([of[i] for i in ids])
        # whitened = centred . u / sqrt(e), so covariance(centred, whitened) = sqrt(e) u
        along = centred.T @ column / n
        assert np.linalg.norm(along) == pytest.approx(math.sqrt(values[k - 1]), rel=1e-9)
        unit = along / np.linalg.norm(along)
        assert np.abs(covariance @ unit - values[k - 1] * unit).max() < 1e-8 * values[0]
        assert np.abs(centred @ unit / math.sqrt(values[k - 1]) - column).max() < 1e-9


@tables
def test_query_against_fractions(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    found = queries.op12_whitening_bit_sliced(spark, FOLDER)
    assert found.columns == COLUMNS
    _held_against_fractions(rows, found.collect())


def test_rows_that_take_no_part(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, d + 1) for d in range(3)]) for i in range(300)]
    odd = [(900, None), (901, []), (902, [1.0, None, 2.0]), (903, [1.0, float("nan"), 2.0]), (904, [float("inf"), 0.0, 0.0]), (905, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, embedding array<double>, n int, component string")
    found = whitening.whitened(frame).withColumnRenamed("id", "vec_id").collect()
    _held_against_fractions(rows, found)


def test_repeated_rows_and_null_ids_count(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [2.0, -1.0]), (3, [0.5, 0.5])]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((str(r["id"]), r["component"]) for r in found) == sorted((str(i), c) for i, _ in rows for c in (1, 2))
    assert {r["n"] for r in found} == {4}


def test_no_variance_and_no_rows(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], schema)).collect() == []
    flat = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert len(flat) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in flat)
    line = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)).collect()
    assert [r["whitened"] is None for r in sorted(line)] == [False, True, False, True]


def test_components_of_any_size(spark):
    """Sums beyond a long are exact; deviations that don't fit one are null."""
    rows = [(i, [v, -float(i)]) for i, v in enumerate([1e15, -1e15, 3e14, 1e300, -1e300])]
    found = whitening.whitened(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows[:3]]
    sums = [sum(c) for c in zip(*x)]
    exact = np.array([[float(Fraction(3 * sum(v[i] * v[j] for v in x) - sums[i] * sums[j], 9)) for j in range(2)] for i in range(2)])
    assert found[0]["explained"] in [pytest.approx(v / np.trace(exact)) for v in np.linalg.eigvalsh(exact)]
    assert all(r["deviation"] is None for r in found)
    assert len(whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()) == 10


def test_popcounts_are_products():
    rng = np.random.default_rng(4)
    x = rng.integers(0, [1, 5, 300], (130, 3)).astype(np.uint64)
    words = whitening.planes(x, [0, 3, 9])
    value = lambda planes: sum(int(np.bitwise_count(p).sum()) << b for b, p in enumerate(planes))
    assert words.shape == (12, 3) and value(words[:3]) == x[:, 1].sum() and value(words[3:]) == x[:, 2].sum()
    product = sum(int(np.bitwise_count(p & q).sum()) << (a + b) for a, p in enumerate(words[:3]) for b, q in enumerate(words[3:]))
    assert product == int((x[:, 1] * x[:, 2]).sum())
