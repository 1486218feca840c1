"""SimHash classes, vector links, components."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone.llm import graph, multi_index, simhash
from tests.llm import brute


def test_components_follow_chains_loops_and_repeats(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)]
    links += [(200, i) for i in range(201, 300)] + [(5, 5), (7, 8), (8, 7)]
    found = dict(graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    want = brute.roots(300, links)
    assert all(found.get(i, i) == want[i] for i in range(300))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _documents():
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "delta", "epsé", "Éta", "theta", "iota", "kappa", "a", "b", "c"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 90))) for _ in range(40)]
    near = []
    for t in texts[:20]:
        parts = t.split(" ")
        for _ in range(3):
            changed = list(parts)
            changed[rng.randrange(len(parts))] = rng.choice(words)
            near.append("\n".join(changed) if rng.random() < 0.3 else "  ".join(changed).upper())
    edge = [None, "", " \t\n", "one", "one two", "ONE two", "one two three", "one two three four", "z " * 5000, "z " * 5001]
    texts = texts + near + edge + [texts[3]] * 5
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("dense", [2, 10**9])
def test_simhash_classes_are_those_of_all_pairs(spark, dense):
    rows = [*_documents(), (None, "one"), (3, None), (3, None)]
    # extra columns with names that the operator uses itself
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, key string, fp int, class_fp int")
    found = simhash.simhash_classes(docs, dense_chain=dense).collect()
    prints, components = brute.simhash_components(rows)
    want = sorted(((r[0], p, c) for r, p, c in zip(rows, prints, components)), key=str)
    assert sorted(((r["id"], r["fp"] % 2**64, r["component_id"]) for r in found), key=str) == want


def test_fingerprints_that_crowd_together(spark):
    rng = np.random.default_rng(0)
    crowd = set()
    for base in rng.integers(0, 2**62, 3).tolist():
        for _ in range(150):
            flipped = base
            for b in rng.choice(63, int(rng.integers(0, 6)), replace=False).tolist():
                flipped ^= 1 << b
            crowd.add(flipped)
    crowd = sorted(crowd)
    table = spark.createDataFrame([(x,) for x in crowd], "fp long")
    links = [(i, j) for i in range(len(crowd)) for j in range(i) if (crowd[i] ^ crowd[j]).bit_count() <= 4]
    want = [crowd[r] for r in brute.roots(len(crowd), links)]
    for dense in (2, 20, 10**9):
        edges = simhash.links(table, dense)
        assert all((r["a"] ^ r["b"]).bit_count() <= 4 for r in edges.collect())
        found = dict(graph.components(edges).collect())
        classes = {}
        for x, w in zip(crowd, want):
            classes.setdefault(w, set()).add(found.get(x, x))
        assert all(len(c) == 1 for c in classes.values()) and len(set.union(*classes.values())) == len(classes)


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = " ".join(str(i * i % 97) for i in range(1000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == whole == brute.simhash(text.decode())


def test_one_of_each_class_stays(spark):
    rows = _documents()
    docs = spark.createDataFrame([(a, b, "k") for a, b in [*rows, rows[0], (None, "other words only here now")]], "doc_id long, text string, __id string")
    kept = simhash.keep_one(docs.withColumnRenamed("__id", "key"))
    assert kept.columns == ["doc_id", "text", "key"]
    _, components = brute.simhash_components(rows)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(components))
    assert kept.where("doc_id IS NULL").count() == 1
    assert simhash.keep_one(docs.limit(0)).count() == 0


def _vectors():
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(150)]
    rows += [(200 + i, [x + rng.gauss(0, 0.05) for x in rows[i % 20][1]]) for i in range(80)]
    rows += [(i, rows[5][1]) for i in range(300, 340)]
    rows += [(400, None), (401, [0.0] * 4), (402, [1.0, float("nan"), 0.0, 1.0]), (403, [1.0, None, 0.0, 1.0]), (404, [])]
    return rows + [(405, [float("inf"), 1.0, 1.0, 1.0]), (500, [1.0, 2.0]), (501, [2.0, 4.0]), (502, [1e-30, 2e-30]), (503, [3.0])]


def _usable(v):
    return v if v and all(x is not None and np.isfinite(x) for x in v) and any(v) else None


@pytest.mark.parametrize("members,visitors", [(3, 5), (512, 2048)])
def test_vector_links_are_those_of_all_pairs(spark, members, visitors):
    rows = _vectors()
    table = spark.createDataFrame([(*r, 1, 2) for r in rows + rows[:3] + [(None, [1.0] * 4)]], "vec_id long, embedding array<double>, cell int, links int")
    found = multi_index.near_duplicates(table, members=members, visitors=visitors, recall=1.0).collect()
    counts, components = brute.cosine_links([(i, _usable(v)) for i, v in rows], 0.95)
    want = sorted((r[0], n, c, r[0] == c) for r, n, c in zip(rows, counts, components))
    got = sorted(tuple(r) for r in found)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want)
    assert sum(g == w for g, w in zip(got, want)) >= 0.9 * len(want)


def test_recall_at_the_threshold_itself():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(3000, 16))
    index = multi_index.fit(points[:2000], 3000, 0.95, 0.99)
    units = points / np.linalg.norm(points, axis=1)[:, None]
    noise = rng.normal(size=units.shape)
    noise -= (noise * units).sum(axis=1)[:, None] * units
    near = 0.95 * units + np.sqrt(1 - 0.95**2) * noise / np.linalg.norm(noise, axis=1)[:, None]
    a, b = index.cells(units), index.cells(near)
    met = [y[0] in x or x[0] in y for x, y in zip(a.tolist(), b.tolist())]
    assert np.mean(met) >= 0.97
    assert index.visits < len(index.left) * len(index.right)


def test_traversal_visits_cells_by_rising_sums():
    rng = np.random.default_rng(1)
    left, right = rng.random(7), rng.random(5)
    cells = multi_index.traverse(left, right, 35)
    sums = [left[i] + right[j] for i, j in cells]
    assert sums == sorted(sums) and len(set(cells)) == 35


def test_no_vectors(spark):
    assert multi_index.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    lone = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in multi_index.near_duplicates(lone).collect()] == [(1, 0, 1, True)]
