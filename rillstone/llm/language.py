"""Language of web pages by Bayesian fusion of evidence.

The logarithms of four kinds of evidence are added per language:

* text: a multinomial model of hashed letter trigrams, fitted to a bounded sample of documents of known language, applied to
  the visible text of the page; a long text counts like `TEXT_UNITS` trigrams, as trigrams aren't independent;
* markup: how likely pages of a language declare what this one declares;
* suffix: how likely pages of a language stand under this one's top-level domain;
* host: a prior smoothed over a hierarchy, the host towards its domain and the domain towards all pages.

The last three are counted over all pages by grouped aggregation, with the posterior from text alone as weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Documents of each language in the training sample, hash space of trigrams, weight of a text in trigrams.
SAMPLE_ROWS, SPACE, TEXT_UNITS = 4_000, 1 << 16, 30.0
#: Pseudo-counts: of a trigram, of declarations and suffixes, of the domain's prior and of the overall prior.
GRAM, DECLARED, HOST, DOMAIN = 0.5, 1.0, 5.0, 5.0
REMEMBERED = 50_000

HIDDEN = re.compile(r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>")
TAG = re.compile(r"(?s)<[^>]*>")
WORD = re.compile(r"[^\W\d_]+")


def _grams(word: str) -> list[int]:
    framed = f" {word} "
    return [zlib.crc32(framed[i : i + 3].encode("utf-8", "surrogatepass")) % SPACE for i in range(len(framed) - 2)]


def _counts(text: str, known: dict[str, np.ndarray]) -> np.ndarray:
    """Hashed trigrams of a text, each as often as it comes."""
    if len(known) > REMEMBERED:
        known.clear()
    parts = []
    for word in WORD.findall(text.lower()):
        grams = known.get(word)
        if grams is None:
            grams = known[word] = np.array(_grams(word), np.int64)
        parts.append(grams)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def visible(html: str) -> str:
    """Text outside of tags, comments, scripts and styles."""
    return TAG.sub(" ", HIDDEN.sub(" ", html))


@dataclass
class TextModel:
    """Languages in order, and the log-probability of each hashed trigram per language."""

    languages: list[str]
    logs: np.ndarray

    def evidence(self, grams: np.ndarray) -> np.ndarray:
        """Log-likelihood per language, scaled down to TEXT_UNITS trigrams."""
        if not len(grams):
            return np.zeros(len(self.languages))
        return self.logs[:, grams].sum(axis=1) * min(1.0, TEXT_UNITS / len(grams))


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, grams, counts = [], [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found, n = np.unique(_counts(text or "", known), return_counts=True)
            langs += [lang] * len(found)
            grams.append(found)
            counts.append(n)
        flat = lambda xs: pa.array(np.concatenate(xs) if xs else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), flat(grams), flat(counts)], ["lang", "gram", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """The text model from the `sample_rows` documents of each language with the smallest hashes of their ids.

    Languages are those of all documents, counted by grouped aggregation; a language of fewer documents is sampled whole.
    What reaches the driver is a row per language and a count per language and hashed trigram, at most SPACE of them for
    each language.  Without any labelled document the model knows the one language `und`.
    """
    place = F.xxhash64(F.col(id_col))
    known = docs.where(F.col(lang_col).isNotNull()).select(F.lower(F.col(lang_col)).alias("lang"), place.alias("place"), F.col(text_col).alias("text"))
    counted = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least")).collect()
    languages = sorted(r["lang"] for r in counted) or ["und"]
    # about twice the rows wanted, so that what is ranked within a language is bounded
    share = lambda n: min(1.0, (2 * sample_rows + 100) / n)
    near = [(r["lang"], max(r["least"], min(2**63 - 1, int(share(r["n"]) * 2**64) - 2**63))) for r in counted]
    bounds = lambda rows: F.broadcast(rows.withColumnRenamed("most", "__most"))
    rough = docs.sparkSession.createDataFrame(near, "lang string, most long")
    ranked = known.select("lang", "place").join(bounds(rough), "lang").where(F.col("place") <= F.col("__most"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    exact = ranked.withColumn("rank", rank).where(F.col("rank") <= sample_rows).groupBy("lang").agg(F.max("place").alias("most"))
    sample = known.join(bounds(exact), "lang").where(F.col("place") <= F.col("__most")).select("lang", "text")
    rows = sample.mapInArrow(_gram_rows, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(languages), SPACE), GRAM)
    if rows.num_rows:
        at = np.searchsorted(languages, rows.column("lang").to_pylist())
        table[at, rows.column("gram").to_numpy()] += rows.column("n").to_numpy()
    return TextModel(languages, np.log(table / table.sum(axis=1, keepdims=True)))


def _text_evidence(model: TextModel):
    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            found = [model.evidence(_counts(visible(html or ""), known)).tolist() for html in batch.column("__html").to_pylist()]
            kept = [n for n in batch.schema.names if n != "__html"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(found, pa.list_(pa.float64()))], [*kept, "text"])

    return evidence


def host_of(url: Column) -> Column:
    """Lower-cased host of an address, without user and port; empty if there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))


def declared_of(html: Column) -> Column:
    """Lower-cased primary language that the root element declares; empty if it doesn't."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?\s*([a-z]{2,8})""", 1))


def _posterior(scores: Column) -> Column:
    """Probabilities from an array of logarithms."""
    most = F.array_max(scores)
    weights = F.transform(scores, lambda x: F.exp(x - most))
    return F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda a, y: a + y))


def _sums(count: int) -> list[Column]:
    return [F.sum(F.get("soft", F.lit(i))).alias(f"c{i}") for i in range(count)]


def _array(count: int) -> Column:
    return F.array(*[F.col(f"c{i}") for i in range(count)])


def _likelihood(pages: DataFrame, key: str, totals: list[float], log: str) -> DataFrame:
    """(key, log): log P(key | language), smoothed over the values that were seen."""
    n = len(totals)
    counted = stored(pages.groupBy(key).agg(*_sums(n)), f"language-{key}")
    values = counted.count()
    logs = [F.log((F.col(f"c{i}") + DECLARED) / (totals[i] + DECLARED * max(1, values))) for i in range(n)]
    return counted.select(F.col(key), F.array(*logs).alias(log))


def identified(
    pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """(id, host, declared, text_lang, lang, confidence): one row per row of `pages`.

    `text_lang` is the best language by the text alone, `lang` by all evidence and `confidence` its probability; ties go to
    the first language by name.  Null or empty html gives no text evidence and an empty declaration, a null or odd url an
    empty host; these are values like any other.  Repeated rows stay and count each time.  An empty table gives no rows.
    Languages are those of the documents.
    """
    model = fit(docs, sample_rows=sample_rows)
    n = len(model.languages)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(
        F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), declared_of(F.col(html_col)).alias("declared"), F.col(html_col).alias("__html")
    )
    found = rows.mapInArrow(_text_evidence(model), f"id {kind}, host string, declared string, text array<double>")
    found = found.withColumn("suffix", F.element_at(F.split("host", r"\."), -1)).withColumn(
        "domain", F.array_join(F.slice(F.split("host", r"\."), F.greatest(F.size(F.split("host", r"\.")) - 1, F.lit(1)), F.lit(2)), ".")
    )
    found = stored(found.withColumn("soft", _posterior(F.col("text"))), "language-text")
    first = found.agg(*_sums(n)).first()
    totals = [first[f"c{i}"] or 0.0 for i in range(n)]
    every = sum(totals) + n
    overall = F.array(*[F.lit((t + 1) / every) for t in totals])
    markup, suffix = _likelihood(found, "declared", totals, "markup"), _likelihood(found, "suffix", totals, "address")
    hosts = stored(found.groupBy("host", "domain").agg(*_sums(n)), "language-hosts")
    domains = hosts.groupBy("domain").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(n)])
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    domains = domains.withColumn("own", _array(n)).select(
        "domain", F.zip_with("own", overall, lambda c, p: (c + DOMAIN * p) / (total(F.col("own")) + DOMAIN)).alias("above")
    )
    hosts = hosts.withColumn("own", _array(n)).join(domains, "domain").select(
        "host", F.zip_with("own", "above", lambda c, p: F.log((c + HOST * p) / (total(F.col("own")) + HOST))).alias("prior")
    )
    hosts = stored(hosts, "language-priors")
    told = found.join(hosts, "host").join(markup, "declared").join(suffix, "suffix")
    parts = F.transform("text", lambda x, i: x + F.get("prior", i) + F.get("markup", i) + F.get("address", i))
    told = told.withColumn("fused", _posterior(parts))
    names = F.array(*[F.lit(x) for x in model.languages])
    best = lambda xs: F.get(names, F.array_position(xs, F.array_max(xs)).cast("int") - 1)
    return told.select("id", "host", "declared", best("soft").alias("text_lang"), best("fused").alias("lang"), F.array_max("fused").alias("confidence"))
