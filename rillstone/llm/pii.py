"""Personal data by candidate generation and boosted trees, in SQL expressions only.

Fixed patterns give the base spans, which are always redacted.  Generators with a higher recall propose more spans, which
may overlap: cards and phones that the base patterns run together, phones without a plus, addresses with brackets.
Each candidate has a few small features of its format and context.  Candidates that are base spans are examples,
candidates that break their own format are counterexamples, and the rest has to be judged.  An address breaks it with a
space beside a bare @ or dot, with a last label that is no top-level domain, or with a capitalised word for a last label.  Equal feature values are
counted over all documents, so the training table is bounded by the number of feature combinations, however many
documents there are; boosted trees of depth two are fitted to those counts.  Per kind, the threshold is the lowest one with
the wanted precision on a fifth of the documents that took no part in the fit.  The trees become a CASE expression, and
spans are selected in a projection of the documents, without any shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, cuts, folded_before, let, plain

KINDS = ("email", "ip", "card", "phone")

#: Base patterns.  They match what the plain ones match: `++` gives up backtracking that can't succeed, and what stands
#: before them skips starts inside a run that has failed at its first character.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap conditions without which a base pattern can't give a span.
BASE_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": "+"}
#: Generators of candidates.
WIDE = {
    "email": r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
WIDE_HINT = {
    "email": r"(?i)@|\(at\)|\[at\]",
    "ip": r"[0-9]\]?\)?[.\[(]",
    "card": r"[0-9]{4}[ -]?[0-9]{4}",
    "phone": r"[0-9]{3}[ .-][0-9]{4}",
}
#: Words near a span that speak for its kind.
CONTEXT = r"(?i)(?:mail|contact|phone|tel|call|mobile|fax|card|visa|credit|pay|account|addr|host|server|ip)"
#: Top-level domains: the general ones in common use; two letters are a country's.
DOMAINS = (
    "com org net edu gov mil int info biz name pro mobi tel travel jobs museum coop aero asia cat post arpa example test invalid "
    "app dev page blog shop store online site website web tech cloud email mail agency company group team work life live news media "
    "design studio art games game digital network systems solutions services software academy school university institute foundation "
    "health care clinic finance bank money legal law consulting global world space earth city town house club social chat wiki xyz top icu"
).split()
#: Characters before a candidate that count as its context.
NEAR = 24

#: Of equal splits the first feature's is taken, so the signs of a broken address come first.
FEATURES = ("spaced", "domain", "capital", "digits", "luhn", "octets", "plus", "parens", "separators", "brackets", "before", "after", "context")
TREES, RATE, PRECISION, SMOOTH = 20, 0.3, 0.99, 1.0


def _hits(text: Column, pattern: str) -> Column:
    """array<(start, stop, hit, before, after)>: matches with their places, and the text around them.

    The pieces between the matches give the places: lengths add up from the start of the text.
    """

    def found(pieces: Column, hits: Column) -> Column:
        def place(hit: Column, i: Column, starts: Column) -> Column:
            piece = F.get(pieces, i)
            start = F.get(starts, i) + F.length(piece)
            return F.struct(
                start.alias("start"), (start + F.length(hit)).alias("stop"), hit.alias("hit"),
                F.right(piece, F.lit(NEAR)).alias("before"), F.substring(F.get(pieces, i + 1), 1, 1).alias("after"),
            )

        lengths = F.transform(hits, lambda hit, i: F.length(hit) + F.length(F.get(pieces, i)))
        return let(folded_before(lengths, lambda a, x: a + x), lambda starts: F.transform(hits, lambda hit, i: place(hit, i, starts)))

    return let(F.split(text, pattern, -1), lambda pieces: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: found(pieces, hits)))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right; only asked for short strings."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(digits).between(1, 40), total % 10 == 0).otherwise(False)


def _octets(hit: Column) -> Column:
    parts = F.split(F.regexp_replace(hit, r"[^0-9.]", ""), r"\.")
    return F.forall(parts, lambda p: F.try_to_number(F.right(F.concat(F.lit("000"), F.regexp_replace(p, "^0+", "")), F.lit(3)), F.lit("000")) + F.when(F.length(F.regexp_replace(p, "^0+", "")) > 3, 1000).otherwise(0) <= 255)


def _valid(kind: str, hit: Column) -> Column:
    digits = _digits(hit)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return _octets(hit) if kind == "ip" else F.lit(True)


def _email_signs(hit: Column) -> tuple[Column, Column, Column]:
    """Whether a space stands beside a bare @ or dot, the last label is a top-level domain, and it is a capitalised word."""
    last = F.regexp_extract(hit, r"([A-Za-z0-9-]+)$", 1)
    domain = F.lower(last).isin(DOMAINS) | last.rlike(r"^(?i)(?:[a-z]{2}|xn--[a-z0-9-]+)$")
    return hit.rlike(r" [@.]|[@.] "), domain, last.rlike(r"^[A-Z][a-z]")


def _if(condition: Column, hits: Column) -> Column:
    return F.when(condition, hits).otherwise(F.expr("CAST(array() AS array<struct<start:bigint,stop:bigint,hit:string,before:string,after:string>>)"))


def _base(text: Column, kind: str) -> Column:
    """array<(kind, start, stop)> of the base spans of a kind."""
    hint = BASE_HINT[kind]
    hinted = F.contains(text, F.lit(hint)) if len(hint) == 1 else text.rlike(hint)
    valid = F.filter(_if(hinted, _hits(text, BASE[kind])), lambda x: _valid(kind, x["hit"]))
    number = F.lit(KINDS.index(kind))
    return F.transform(valid, lambda x: F.struct(number.alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))


def _class(c: Column) -> Column:
    """Of a neighbouring character: 0 none, 1 white space, 2 letter, 3 digit, 4 quote or assignment, 5 other."""
    return (
        F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^\p{L}"), 2)
        .when(c.rlike("^[0-9]"), 3).when(c.rlike("""^["'=:]"""), 4).otherwise(5)
    )


def _wide(text: Column, kind: str) -> Column:
    """array of candidates of a kind: kind, start, stop, broken, and the features (all small numbers)."""

    def described(x: Column) -> Column:
        hit, digits = x["hit"], _digits(x["hit"])
        flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
        broken = ~_valid(kind, hit) | F.right(x["before"], F.lit(1)).rlike(r"^\p{L}") | F.coalesce(x["after"], F.lit("")).rlike(r"^\p{L}")
        spaced, domain, capital = _email_signs(hit) if kind == "email" else [F.lit(False)] * 3
        if kind == "email":
            broken = spaced | ~domain | capital
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), flag(broken).alias("broken"),
            F.least(F.length(digits), F.lit(20)).alias("digits"), flag(_luhn(digits)).alias("luhn"),
            flag(_octets(hit) if kind == "ip" else F.lit(False)).alias("octets"), flag(F.contains(hit, F.lit("+"))).alias("plus"),
            flag(F.contains(hit, F.lit("("))).alias("parens"), F.least(F.length(F.regexp_replace(hit, r"[^ .-]", "")), F.lit(6)).alias("separators"),
            flag(hit.rlike(r"[\[(](?:\.|at|dot)")).alias("brackets"), _class(F.right(x["before"], F.lit(1))).alias("before"),
            _class(x["after"]).alias("after"), flag(x["before"].rlike(CONTEXT)).alias("context"),
            flag(spaced).alias("spaced"), flag(domain).alias("domain"), flag(capital).alias("capital"),
        )

    return F.transform(_if(text.rlike(WIDE_HINT[kind]), _hits(text, WIDE[kind])), described)


@dataclass
class Trees:
    """Per kind: prior log-odds, trees of depth two [(split, left, right)], threshold.  Kinds without examples, and addresses without counterexamples, select nothing."""

    prior: dict[int, float] = field(default_factory=dict)
    trees: dict[int, list[tuple]] = field(default_factory=dict)
    threshold: dict[int, float] = field(default_factory=dict)

    def margin(self, kind: int, row: tuple[int, ...]) -> float:
        total = self.prior[kind]
        for tree in self.trees[kind]:
            while len(tree) == 4:
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            total += tree[0]
        return total

    def score(self, candidate: Column) -> Column:
        """Probability of a candidate as an expression."""

        def value(tree: tuple) -> Column:
            if len(tree) == 1:
                return F.lit(float(tree[0]))
            at, most, left, right = tree
            return F.when(candidate[FEATURES[at]] <= most, value(left)).otherwise(value(right))

        out = F.lit(0.0)
        for kind, prior in self.prior.items():
            margin = F.lit(float(prior))
            for tree in self.trees[kind]:
                margin = margin + value(tree)
            out = F.when(candidate["kind"] == kind, 1 / (1 + F.exp(-margin))).otherwise(out)
        return out

    def selected(self, candidate: Column) -> Column:
        out = F.lit(False)
        for kind, threshold in self.threshold.items():
            out = F.when(candidate["kind"] == kind, self.score(candidate) >= threshold).otherwise(out)
        return out


def _grow(rows: list[tuple], depth: int) -> tuple:
    """A regression tree on (features, gradient, curvature); leaves are Newton steps."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = (RATE * g / (h + SMOOTH),)
    if not depth:
        return leaf
    best, found = g * g / (h + SMOOTH) + 1e-9, None
    for at in range(len(rows[0][0])):
        for most in sorted({r[0][at] for r in rows})[:-1]:
            gl, hl = sum(r[1] for r in rows if r[0][at] <= most), sum(r[2] for r in rows if r[0][at] <= most)
            gain = gl * gl / (hl + SMOOTH) + (g - gl) ** 2 / (h - hl + SMOOTH)
            if gain > best:
                best, found = gain, (at, most)
    if found is None:
        return leaf
    at, most = found
    return at, most, _grow([r for r in rows if r[0][at] <= most], depth - 1), _grow([r for r in rows if r[0][at] > most], depth - 1)


def fit(counts: list[tuple[int, tuple[int, ...], int, int, int]], trees: int = TREES, precision: float = PRECISION) -> Trees:
    """Boosted trees from (kind, features, label, calibration 0/1, count)."""
    model = Trees()
    for kind in range(len(KINDS)):
        own = [c for c in counts if c[0] == kind]
        weight = lambda label, part: sum(c[4] for c in own if c[2] == label and c[3] == part)  # noqa: E731, B023
        if not weight(1, 0) or kind == KINDS.index("email") and not weight(0, 0):
            continue  # nothing to judge by; the wide patterns of the other kinds are strict
        odds = math.log((weight(1, 0) + SMOOTH) / (weight(0, 0) + SMOOTH))
        model.prior[kind], model.trees[kind] = odds, []
        fitted = sorted((c for c in own if not c[3]), key=lambda c: (c[1], c[2]))
        for _ in range(trees if weight(0, 0) else 0):
            rows = []
            for _, features, label, _, n in fitted:
                p = 1 / (1 + math.exp(-model.margin(kind, features)))
                rows.append((features, n * (label - p), n * p * (1 - p)))
            model.trees[kind].append(_grow(rows, 2))
        scored = sorted(((1 / (1 + math.exp(-model.margin(kind, c[1]))), c[2], c[4]) for c in own if c[3]), reverse=True)
        model.threshold[kind] = 0.9
        right = wrong = 0
        lowest = None
        for i, (score, label, n) in enumerate(scored):
            right, wrong = right + n * label, wrong + n * (1 - label)
            ended = i + 1 == len(scored) or scored[i + 1][0] < score
            if ended and score >= 0.5 and (right + SMOOTH) / (right + wrong + 2 * SMOOTH) >= precision:
                lowest = score
        if lowest is not None:
            model.threshold[kind] = lowest - 1e-9  # Spark's exponential may differ in the last digit
    return model


def _found(docs: DataFrame, text_col: str) -> DataFrame:
    """`docs` with __base and __wide: arrays of the base spans and of the candidates."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = docs.withColumn("__base", F.concat(*[_base(text, k) for k in KINDS]))
    return docs.withColumn("__wide", F.concat(*[_wide(text, k) for k in KINDS]))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, precision: float = PRECISION) -> Trees:
    """Fit the trees to the candidates of all documents, as counts of equal feature values.

    The rows that reach the driver are at most the combinations of thirteen small features, two labels and two folds.
    """
    found = _found(docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")), "__text")
    keys = F.transform("__base", lambda b: F.struct(b["kind"], b["start"], b["stop"]))
    known = F.arrays_overlap(F.array(F.struct(F.col("c.kind"), F.col("c.start"), F.col("c.stop"))), F.col("keys"))
    rows = (
        found.where(F.size("__wide") > 0)
        .withColumn("keys", keys)
        .select("__id", "keys", F.explode("__wide").alias("c"))
        .withColumn("label", F.when(known, 1).when(F.col("c.broken") == 1, 0))
        .where(F.col("label").isNotNull())
        .withColumn("part", (F.pmod(F.xxhash64(F.lit(11), "__id"), F.lit(5)) == 0).cast("int"))
    )
    grouped = rows.groupBy("c.kind", *[F.col(f"c.{f}").alias(f) for f in FEATURES], "label", "part").count().collect()
    return fit([(r["kind"], tuple(r[f] for f in FEATURES), r["label"], r["part"], r["count"]) for r in grouped], trees, precision)


def _extents(column: str) -> Column:
    """array<(low, high, items)>: the spans in order of their place, by blocks, with the extent of each block."""
    ordered = F.array_sort(column, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    extent = lambda xs: F.struct(
        F.array_min(F.transform(xs, lambda x: x["start"])).alias("low"), F.array_max(F.transform(xs, lambda x: x["stop"])).alias("high"), xs.alias("items")
    )
    return let(ordered, lambda xs: F.transform(blocks(xs), extent))


def _meets_any(extents: Column, x: Column, test: Callable[[Column, Column], Column]) -> Column:
    """Whether `x` overlaps a span y with test(x, y); only the blocks that `x` reaches are looked through."""
    near = lambda b: (b["low"] < x["stop"]) & (x["start"] < b["high"])
    meets = lambda y: (x["start"] < y["stop"]) & (y["start"] < x["stop"]) & test(x, y)
    return F.exists(F.filter(extents, near), lambda b: F.exists(b["items"], meets))


def spans(docs: DataFrame, model: Trees, text_col: str = "text", base_col: str = "base", spans_col: str = "spans") -> DataFrame:
    """`docs` with two columns, `base` and `spans`: arrays of (start, kind, stop), kind as a number in KINDS, in order.

    Places are code points, the end exclusive.  `spans` holds the base spans and the selected candidates that don't
    overlap a base span or a better candidate.  Null and empty texts have none.  Rows, repeated ones included, stay
    as they are; a projection is all that happens.
    """
    found = _found(docs, text_col)
    key = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))
    ordered = lambda xs: F.array_sort(F.transform(xs, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"))))
    chosen = F.transform(
        F.filter("__wide", model.selected),
        lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), model.score(x).alias("score")),
    )
    found = found.withColumn("__wide", F.when(F.size("__wide") > 0, chosen))
    every = lambda x, y: F.lit(True)
    found = found.withColumn("__wide", let(_extents("__base"), lambda taken: F.filter("__wide", lambda x: ~_meets_any(taken, x, every))))
    rank = lambda x: F.struct(-x["score"], x["kind"], x["start"])
    better = lambda x, y: rank(y) < rank(x)
    best = let(_extents("__wide"), lambda rivals: F.filter("__wide", lambda x: ~_meets_any(rivals, x, better)))
    extra = F.when(F.size("__wide") > 0, F.transform(best, key))
    found = found.withColumn(spans_col, ordered(F.concat("__base", F.coalesce(extra, F.slice("__base", 1, 0)))))
    return found.withColumn(base_col, ordered(F.col("__base"))).drop("__base", "__wide")


def listed(column: str) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["stop"])), ",")


def counted(column: str, kind: int) -> Column:
    """Number of spans of a kind; the kind is a name of this function, as a second parameter would be the span's place."""
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")


def redacted(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length_col: str | None = "n_chars") -> DataFrame:
    """`docs` with every span replaced by its kind in capitals and brackets; null texts stay null.

    Spans that overlap are replaced as one, under the kind of the first.  `length_col`, if it is a column, gets the new length.
    """
    docs, renamed = plain(docs)
    id_col, text_col, length_col = renamed[id_col], renamed[text_col], renamed.get(length_col)
    found = spans(docs, train(docs, id_col, text_col), text_col, "__base_spans", "__spans")
    text = F.col(f"`{text_col}`")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def replaced(found: Column, reach: Column) -> Column:
        last = F.array_max(F.transform(found, lambda s: s["stop"]))
        kept = F.filter(F.zip_with(found, reach, lambda s, at: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), at.alias("at"))), lambda s: s["start"] >= s["at"])
        place = lambda start, length: F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"))
        between = let(kept, lambda ks: F.concat(F.transform(ks, lambda s: place(s["at"], s["start"] - s["at"])), F.array(place(last, F.length(text) - last))))
        named = F.concat(F.transform(kept, lambda s: names[s["kind"]]), F.array(F.lit("")))
        return F.array_join(F.zip_with(cuts(text, between), named, lambda a, b: F.concat(a, b)), "")

    reach = folded_before(F.transform("__spans", lambda s: s["stop"]), F.greatest)
    out = found.withColumn("__new", F.when(F.size("__spans") > 0, let(reach, lambda at: replaced(F.col("__spans"), at))).otherwise(text))
    changed = {text_col: F.col("__new")}
    if length_col:
        changed[length_col] = F.when(F.size("__spans") > 0, F.length("__new").cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col))
    return out.select(*[changed.get(n, F.col(n)).alias(n) for n in docs.columns]).toDF(*renamed)
