"""Toxicity by a classifier whose scores may not depend on which group a text mentions.

A logistic model over the words of a text (as they are, and by their first four and five letters) is fitted to a
bounded, balanced sample of labelled rows.  For each sampled text that names a group of people, counterfactual
texts are made by swapping each identity term for another term of its axis and for the axis' neutral word.  A text that
names none gets a neutral mention, of one group and of another of the same axis, so that there are pairs whatever the
corpus talks about.  The fit is penalised by the squared change of score of every pair.  A soft threshold keeps only words that carry evidence, so a
very long clean text gathers no score from its length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain, stored

LETTERS = re.compile(r"[^\W\d_]+")
#: Size of the hash space of features; the model keeps those with a weight.
SPACE = 1 << 24
#: Bounds of the training sample, in rows of each class.
TOXIC_ROWS, CLEAN_ROWS = 2_000, 4_000
#: Words whose features a task remembers; beyond it starts anew.
REMEMBERED = 100_000

#: Terms that name groups of people, by axis; the first of each is neutral.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("person", "man", "woman", "boy", "girl", "transgender", "nonbinary"),
    ("people", "men", "women", "boys", "girls"),
    ("believer", "christian", "muslim", "jew", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("believers", "christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("religious", "jewish", "islamic"),
    ("adult", "straight", "gay", "lesbian", "bisexual", "queer"),
    ("human", "black", "white", "asian", "african", "european", "latino", "arab", "indigenous"),
    ("resident", "immigrant", "refugee", "foreigner", "migrant"),
    ("residents", "immigrants", "refugees", "foreigners", "migrants"),
    ("patient", "disabled", "blind", "deaf", "autistic"),
)


def _features(word: str) -> set[int]:
    """Hashed features of one space-separated, lower-cased piece of text."""
    found = set()
    for run in LETTERS.findall(word):
        for feature in (run, f"^{run[:4]}", f"^{run[:5]}"):
            found.add(zlib.crc32(feature.encode("utf-8", "surrogatepass")) % SPACE)
    return found


def _words(text: bytes | None) -> set[str]:
    return set((text or b"").decode("utf-8", "replace").lower().split())


def _text_features(words: set[str]) -> np.ndarray:
    found: set[int] = set()
    for word in words:
        found |= _features(word)
    return np.array(sorted(found), np.int32)


def swapped(words: set[str], terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> list[set[str]]:
    """Counterfactuals of a set of words: each term as the next one of its axis, and as the neutral word."""
    following, neutral = {}, {}
    for axis in terms:
        for i, term in enumerate(axis):
            following[term] = axis[(i + 1) % len(axis)]
            neutral[term] = axis[0]
    named = {w: run for w in words for run in LETTERS.findall(w) if run in neutral}
    if not named:
        return []
    out = []
    for table in (following, neutral):
        changed = {w.replace(run, table[run]) for w, run in named.items()} | (words - set(named))
        if changed != words:
            out.append(changed)
    return out


def mentioning(words: set[str], terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> list[set[str]]:
    """Counterfactuals of a set of words that names no group: with one term of an axis, and with the next.

    The words decide which ones, so all terms are mentioned about equally often in either class.
    """
    every = [(axis, i) for axis in terms for i in range(len(axis))]
    if not every or not words:
        return []
    axis, i = every[zlib.crc32(" ".join(sorted(words)).encode("utf-8", "surrogatepass")) % len(every)]
    return [words | {axis[i]}, words | {axis[(i + 1) % len(axis)]}]


@dataclass
class Model:
    """Weights by feature, the bias, and the counterfactual pairs and those of them that hold a feature of the sample.

    Without both classes in the sample there are no weights.
    """

    bias: float
    weights: dict[int, float] = field(default_factory=dict)
    pairs: int = 0
    active_pairs: int = 0

    def score_words(self, words: set[str]) -> float:
        found: set[int] = set()
        for word in words:
            found |= _features(word)
        return self.of({f for f in found if f in self.weights})

    def of(self, active: set[int]) -> float:
        total = self.bias + sum(self.weights[f] for f in sorted(active))
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def held_out(id_col: str) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 0 when divided by five; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, toxic_rows: int, clean_rows: int) -> DataFrame:
    """(id, label, text) of the training sample: labelled, not held out, the rows of each class with the smallest hashes.

    An id labelled more than once counts as toxic if any of its labels does; of several texts of an id the smallest is taken.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id"))
        .agg((F.max(label_col) > 0).cast("int").alias("label"))
    )
    taken = [known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(n) for c, n in ((1, toxic_rows), (0, clean_rows))]
    chosen = taken[0].unionByName(taken[1])
    # at most toxic_rows + clean_rows rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))


_CHANGES = "array<struct<gone: array<int>, new: array<int>>>"


def _sample_features(terms: Sequence[Sequence[str]]):
    """Features of the texts, and what each counterfactual text lacks and has more."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, changes = [], []
            for text in batch.column("text"):
                words = _words(text.as_py())
                mine = _text_features(words)
                own.append(mine)
                others = [_text_features(x) for x in swapped(words, terms) or mentioning(words, terms)]
                changes.append([{"gone": np.setdiff1d(mine, x), "new": np.setdiff1d(x, mine)} for x in others])
            lists = pa.list_(pa.int32())
            kind = pa.list_(pa.struct([("gone", lists), ("new", lists)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(own, lists), pa.array(changes, kind)], ["id", "label", "own", "changes"]
            )

    return features


class _Sparse:
    """Rows of feature numbers, as one flat array with offsets."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.sizes)
        self.n, self.width = len(rows), width

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.flat], self.n) if self.n else np.zeros(0)

    def back(self, per_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, np.repeat(per_row, self.sizes), self.width) if self.n else np.zeros(self.width)


def _fit(own, labels, changes, ridge: float, lasso: float, fairness: float, steps: int) -> Model:
    """`own` holds the features of each text that other texts have too, `changes` those of its counterfactuals."""
    labels = np.asarray(labels, float)
    positive = labels.sum()
    pairs = sum(map(len, changes))
    if not 0 < positive < len(labels):
        share = (positive + 1) / (len(labels) + 2) if len(labels) else 0.01
        return Model(float(np.log(share / (1 - share))), pairs=pairs)
    sizes = [len(r) for r in own]
    names, inverse = np.unique(np.concatenate(own), return_inverse=True)
    own.clear()
    x = _Sparse(np.split(inverse, np.cumsum(sizes)[:-1]), len(names))
    del inverse
    index = {int(f): i for i, f in enumerate(names)}
    known = lambda side: _Sparse([np.array([index[f] for f in c[side] if f in index], np.int64) for rows in changes for c in rows], len(names))
    gone, new = known("gone"), known("new")
    weights, bias = np.zeros(len(names)), float(np.log(positive / (len(labels) - positive)))
    first, second, b1, b2 = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    for step in range(1, steps + 1):
        error = (1 / (1 + np.exp(-np.clip(x.dot(weights) + bias, -40, 40))) - labels) / len(labels)
        gradient = x.back(error) + ridge * weights
        if pairs:
            change = (new.dot(weights) - gone.dot(weights)) * 2 * fairness / pairs
            gradient += new.back(change) - gone.back(change)
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        b1, b2 = 0.9 * b1 + 0.1 * error.sum(), 0.99 * b2 + 0.01 * error.sum() ** 2
        scale = np.sqrt(second / (1 - 0.99**step)) + 1e-6
        rate = 0.1 / scale
        weights = weights - rate * first / (1 - 0.9**step)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * lasso, 0)
        bias -= 0.1 * b1 / (1 - 0.9**step) / (np.sqrt(b2 / (1 - 0.99**step)) + 1e-6)
    used = np.flatnonzero(weights)
    active = int(((gone.sizes + new.sizes) > 0).sum())
    return Model(bias, {int(names[i]): float(weights[i]) for i in used}, pairs, active)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    terms: Sequence[Sequence[str]] = IDENTITY_TERMS,
    toxic_rows: int = TOXIC_ROWS,
    clean_rows: int = CLEAN_ROWS,
    ridge: float = 1e-5,
    lasso: float = 1e-4,
    fairness: float = 1.0,
    steps: int = 250,
) -> Model:
    """Fit the model to at most `toxic_rows` + `clean_rows` labelled rows that are not held out.

    Labels with a null id or label are left out.  Without rows of both classes the model has no weights and gives
    every text the smoothed share of toxic labels (0.01 without any).  The sample comes to the driver as feature
    numbers, in the order of the ids, so reruns agree.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = sample(docs, labels, id_col, text_col, label_col, toxic_rows, clean_rows)
    made = rows.mapInArrow(_sample_features(terms), f"id {kind}, label int, own array<int>, changes {_CHANGES}")
    made = stored(made, "toxicity-sample")
    # features of fewer than two texts can't generalise; they don't come to the driver
    each = made.select("id", F.explode("own").alias("f"))
    common = stored(each.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f"), "toxicity-features")
    kept = each.join(common, "f").groupBy("id").agg(F.sort_array(F.collect_list("f")).alias("own"))
    found = made.drop("own").join(kept, "id", "left").toArrow().sort_by("id")
    own = [np.asarray(r.values if r.is_valid else [], np.int32) for r in found.column("own")]
    changes = found.column("changes").to_pylist()
    labels = found.column("label").to_pylist()
    del found
    return _fit(own, labels, changes, ridge, lasso, fairness, steps)


def _score(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        weights = model.weights
        for batch in batches:
            scores = []
            for text in batch.column("__text"):
                words = _words(text.as_py())
                if len(known) > REMEMBERED:
                    known.clear()
                active: set[int] = set()
                for word in words:
                    features = known.get(word)
                    if features is None:
                        features = known[word] = tuple(f for f in _features(word) if f in weights)
                    if features:
                        active.update(features)
                scores.append(model.of(active))
            names = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(scores, pa.float64())], [*names, "__score"])

    return score


def scored(docs: DataFrame, model: Model, keep: Sequence[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns `keep` of every row, and the score of its whole text between 0 and 1.

    Null and empty texts score the bias alone.  Repeated rows each keep their row; nothing but the text enters
    the score.  An empty table gives no rows.
    """
    rows = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text_col}`").cast("binary").alias("__text"))
    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField("__score", T.DoubleType())])
    return rows.mapInArrow(_score(model), schema).withColumnRenamed("__score", score_col)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that score below the threshold, with all their columns."""
    model = train(docs, labels, id_col, text_col)
    docs, names = plain(docs)
    kept = scored(docs, model, docs.columns, names[text_col]).where(F.col("score") < threshold)
    return kept.select(*docs.columns).toDF(*names)
