"""Repeated byte strings: the suffix sort and the operator against a table of all strings."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone.llm import queries, suffix_array
from tests.llm.test_corpus import FOLDER, tables


def _brute(rows, length):
    seen = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t)))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), runs, kept))
    return sorted(out, key=str)


def _rows(seed, n):
    rng = random.Random(seed)
    some = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    base = some("abcé", 200, 200)
    rows = [(None, None), (1, ""), (2, "x" * 300), (2, "x" * 300), (3, "ab" * 200), (4, None), (None, "no id" * 9)]
    for i in range(n):
        text = some("abcdefgh", 0, 60)
        if rng.random() < 0.7:
            at = rng.randint(0, 150)
            text += base[at : at + rng.randint(5, 60)]
        if rng.random() < 0.1:
            text += "z" * rng.randint(1, 60)
        rows.append((10 + i, text + some("abcdefgh", 0, 30)))
    return rows + rows[10:14]


def _core(texts, length, gram):
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    key, *places = suffix_array.anchors(data, ends, length, gram)
    order = np.argsort(key, kind="stable")
    return data, key[order], *(p[order] for p in places)


@pytest.mark.parametrize("seed", range(8))
def test_sorted_neighbours_find_every_repeat(seed):
    texts = [(t or "").encode() for _, t in _rows(seed, 60)]
    data, key, anchor, low, high = _core(texts, 20, 6)
    assert (high - low + 1).sum() == sum(max(0, len(t) - 19) for t in texts)  # every string has one anchor
    found = suffix_array.repeats(data, key, anchor, low, high, 20)
    wanted = suffix_array.repeats_by_bytes(data, key, anchor, low, high, 20)
    assert all((a == b).all() for a, b in zip(found, wanted))


def test_suffixes_are_in_order():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    start = end - [len(t) for t in texts]
    group = np.sort(np.array([rng.randint(0, 5) for _ in texts]))
    suffixes = suffix_array._Suffixes(data, group, start, end)
    order = suffixes.sorted()
    assert order.tolist() == sorted(range(300), key=lambda i: (group[i], texts[i], i))
    assert suffixes.in_order(order) and not suffixes.in_order(order[::-1])


def test_hashes_that_collide_are_noticed(monkeypatch):
    texts = [(t or "").encode() for _, t in _rows(1, 40)]
    items = _core(texts, 20, 6)
    wanted = suffix_array.repeats_by_bytes(*items, 20)
    monkeypatch.setattr(suffix_array.Prefixes, "of", lambda self, start, size: (self.sums[start + size] - self.sums[start]) * np.uint64(0))
    found = suffix_array.repeats(*items, 20)
    assert all((a == b).all() for a, b in zip(found, wanted))


@pytest.mark.parametrize("group, part", [(1_024, 1 << 18), (3, 64)])
def test_repeated_against_brute_force(spark, group, part):
    """Hot grams are cut with groups of 3, texts are hashed in parts of 64 bytes; column names clash."""
    rows = _rows(9, 100)
    docs = spark.createDataFrame([(i, t, 0, "q", 1.0) for i, t in rows], "doc_id long, text string, h1 int, spans string, key double")
    found = suffix_array.repeated(docs, length=20, gram=6, group=group, part=part)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    wanted = [(*r[:4], digest(r[4])) for r in _brute(rows, 20)]
    got = [(r["id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in found.collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_no_rows_and_no_repeats(spark):
    assert suffix_array.repeated(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, None), (2, ""), (3, "short"), (4, "x" * 199), (5, "x" * 199)]
    found = suffix_array.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 5 and all(r["n_removed"] == 0 and r["spans"] == [] for r in found)
    with pytest.raises(ValueError):
        suffix_array.repeated(spark.createDataFrame(rows, "doc_id long, text string"), length=10, gram=11)


def test_spans_are_cut_out(spark):
    spans = "array<struct<start: bigint, end: bigint>>"
    row = spark.createDataFrame([("abécd", [(1, 4)]), (None, []), ("xy", [(0, 2)]), ("abcdef", [(0, 1), (3, 5)])], f"text string, spans {spans}")
    kept = [bytes(r[0]) for r in row.select(suffix_array.removed(F.col("text"), F.col("spans"))).collect()]
    assert kept == [b"acd", b"", b"", b"bcf"]


@tables
def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op11_suffix_repeats(spark, FOLDER)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    wanted = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in _brute(rows, 200)]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(wanted, key=str)
    assert any(r[2] for r in wanted)
