"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib

import pytest

from rillstone.llm import queries, spelling
from tests.llm.test_corpus import FOLDER, tables


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _forms(counts):
    out = {}
    for word, n in counts.items():
        near = [w for w in counts if _one_edit(word, w)]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form = best if best is not None and counts[best] >= 5 * n else None
        out[word] = (form, len(near), counts[form] if form else None)
    rows = []
    for word, (form, near, form_n) in out.items():
        root = word
        while out[root][0]:
            root = out[root][0]
        rows.append((word, form, root, counts[word], near, form_n))
    return sorted(rows, key=str)


def _counts(rows, least):
    counts = {}
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 6:
                counts[word] = counts.get(word, 0) + 1
    return {w: n for w, n in counts.items() if n >= least}


@pytest.mark.parametrize("letters", ["ab", "abcdefghijé"])
def test_index_finds_words_one_edit_away(letters):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(200)})
    index = spelling.PositionIndex(words)
    for word in [*words, "", "zzzz"]:
        assert [words[i] for i in index.near(word)] == [w for w in words if _one_edit(word, w)]
    assert spelling.PositionIndex([]).near("a") == []


@pytest.mark.parametrize("block", [16_384, 7])
def test_variants_against_all_pairs(spark, block):
    """Full blocks are cut into a grid with 7 words to a part."""
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcd") for _ in range(rng.randint(6, 9))) for _ in range(12)]
    counts = {}
    for stem in stems:
        counts[stem] = 10 ** rng.randint(1, 5)
        for _ in range(25):
            i, c = rng.randint(0, len(stem) - 1), rng.choice("abcdé")
            word = rng.choice([stem[:i] + stem[i + 1 :], stem[:i] + c + stem[i:], stem[:i] + c + stem[i + 1 :], stem + c])
            if len(word) >= 2:
                counts.setdefault(word, rng.choice([5, 5, 7, 30, 150, 900]))
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = spelling.rooted(spelling.variants(words, block)).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted((tuple(r) for r in found.collect()), key=str) == _forms(counts)


def test_words_of_documents(spark):
    rng = random.Random(7)
    words = ["Beispiel", "beispeil", "ÀÉlöwen", "straße", "Straßen", "kurz", "x" * 300, "garden", "gardens", "GARDENS"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(400)]
    rows += [(None, "garden-gardens" * 3), (5, None), (6, ""), (7, "1234 !?"), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n int, word string")
    found = spelling.spelling_variants(docs).collect()
    assert sorted((tuple(r) for r in found), key=str) == _forms(_counts(rows, 5))
    assert any(r["form"] for r in found)
    assert spelling.spelling_variants(docs.limit(0)).collect() == []


@tables
def test_query_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op13_spelling_position_index(spark, FOLDER)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    counts = _counts(rows, 5)
    assert sorted((tuple(r) for r in found.collect()), key=str) == _forms(counts)
