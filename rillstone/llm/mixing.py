"""Mixing sources to target weights by Sainte-Laguë apportionment.

Weights become word targets per source, targets become blocks of equally many words, and the blocks go to the
sources by the highest quotients target / (2k - 1).  The rows of a source are dealt into shards of bounded size by
a seeded hash, and the source's blocks go to its shards by the same rule, so each shard has an integer quota.
Within a shard the rows lie end to end in a seeded order; the quota takes whole turns of that line and then the
blocks from a seeded place on.  Almost every document is thereby taken a whole number of times; only those at the two
ends of a shard's last turn are taken in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, plain, ranked, row_key, stored

#: Words per block, rows per shard.
BLOCK_WORDS, SHARD_ROWS = 16, 4_096
SEED = 20


def _text(*parts: Column | str | int) -> Column:
    """Parts as one text with slashes between; nulls are empty."""
    columns = [F.col(p) if isinstance(p, str) else F.lit(p) if isinstance(p, int) else p for p in parts]
    return F.concat_ws("/", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def _number(*parts: Column | str | int) -> Column:
    """A number of 60 bits from the md5 of the parts."""
    return F.conv(F.substring(F.md5(_text(*parts)), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, key, source, size, serial): the words of every row, written once so that texts are read once; serials tell rows apart."""
    return stored(
        docs.select(
            F.col(id_col).alias("id"),
            row_key(docs).alias("key"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
            F.monotonically_increasing_id().alias("serial"),
        ),
        "sizes",
    )


def targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, place, weight, n_rows, source_size, target): one row per source.

    Sources take the weights in turn, by code point with null last, and share `share` of all words.  No target goes
    over `most` times its source's size; what is over is shared out again by weight until none is above.
    """
    per_source = sized.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    placed = ranked(per_source, [F.col("source").asc_nulls_last()], "place")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    placed = stored(placed.withColumn("weight", turn[(F.col("place") % len(weights)).cast("int")]), "sources")
    total = share * (placed.agg(F.sum("source_size")).first()[0] or 0)
    most_words = F.col("source_size") * F.lit(float(most))
    rate, before = 0.0, -1.0
    while total and rate != before:  # the rate only grows, and each round stops at least one more source
        capped = F.col("weight") * F.lit(rate) > most_words
        row = placed.agg(
            F.sum(F.when(capped, most_words)).alias("fixed"), F.sum(F.when(~capped, F.col("weight"))).alias("open")
        ).first()
        before = rate
        if row["open"]:
            rate = max(rate, (total - (row["fixed"] or 0.0)) / row["open"])
    return placed.withColumn("target", F.least(F.col("weight") * F.lit(rate), most_words))


def _quotients(rows: DataFrame, votes: Column, seats: Column, total: Column, members: Column) -> DataFrame:
    """Seats that are certain (`base`), and how many more quotients of a member could win (`open`).

    With V votes, N seats and n members the last winning quotient lies between V / (2N + n) and V / (2N - n), so all
    but about 2n quotients are decided without being listed.
    """
    high = F.when(2 * seats > members, total / (2 * seats - members))
    low = total / (2 * seats + members)
    none = (votes <= 0) | (seats <= 0)
    base = F.greatest(F.lit(0), F.floor((votes / high + 1) / 2) - 1)
    top = F.floor((votes / low + 1) / 2) + 1
    return rows.withColumn("base", F.when(none, 0).otherwise(F.coalesce(base, F.lit(0))).cast("long")).withColumn(
        "open", F.when(none, 0).otherwise(top - F.col("base")).cast("long")
    )


def _candidates(rows: DataFrame, votes: Column, keep: list[str]) -> DataFrame:
    numbers = F.when(F.col("open") > 0, F.sequence(F.col("base") + 1, F.col("base") + F.col("open")))
    return rows.select(*keep, votes.alias("votes"), F.explode(numbers).alias("seat")).withColumn(
        "quotient", F.col("votes") / (2 * F.col("seat") - 1)
    )


def source_quotas(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`sources` with `blocks`: Sainte-Laguë seats by target; equal quotients go to the earlier source."""
    row = sources.agg(F.sum("target").alias("total"), F.count(F.when(F.col("target") > 0, 1)).alias("n")).first()
    seats = int((row["total"] or 0.0) / block_words + 0.5)
    votes = F.col("target")
    open_ = stored(_quotients(sources, votes, F.lit(seats), F.lit(row["total"] or 0.0), F.lit(row["n"])), "quotients")
    rest = seats - (open_.agg(F.sum("base")).first()[0] or 0)
    order = [F.col("quotient").desc(), F.col("place"), F.col("seat")]
    won = ranked(_candidates(open_, votes, ["place"]), order, "number").where(F.col("number") < rest)
    more = won.groupBy("place").agg(F.count("*").alias("more"))
    return open_.join(more, "place", "left").withColumn("blocks", F.col("base") + F.coalesce("more", F.lit(0))).drop("base", "open", "more")


def shard_quotas(shards: DataFrame) -> DataFrame:
    """`shards` (source, shard, words, with the source's `blocks`) with `quota`: seats by words within the source.

    The windows hold one row per shard of a source, a few thousandths of a thousandth of its words.
    """
    source = Window.partitionBy("source")
    votes = F.col("words")
    rows = shards.withColumn("__total", F.sum("words").over(source)).withColumn(
        "__n", F.count(F.when(F.col("words") > 0, 1)).over(source)
    )
    rows = _quotients(rows, votes, F.col("blocks"), F.col("__total"), F.col("__n"))
    rows = stored(rows.withColumn("__rest", F.col("blocks") - F.sum("base").over(source)), "shards")
    order = Window.partitionBy("source").orderBy(F.col("quotient").desc(), "shard", "seat")
    won = _candidates(rows, votes, ["source", "shard", "__rest"]).withColumn("number", F.row_number().over(order))
    more = won.where("number <= __rest").groupBy(F.col("source").alias("__source"), F.col("shard").alias("__shard")).agg(
        F.count("*").alias("more")
    )
    same = F.col("source").eqNullSafe(F.col("__source")) & (F.col("shard") == F.col("__shard"))
    return rows.join(more, same, "left").select(
        "source", "shard", "words", (F.col("base") + F.coalesce("more", F.lit(0))).alias("quota")
    )


def _dealt(rows: DataFrame, seed: int, shard_rows: int) -> DataFrame:
    """`rows` with `shard`: by a seeded hash of id and size, so that a shard holds about `shard_rows` rows.

    Rows of one id and size meet.  Where they fill a shard with more than twice its rows, the rows of that shard are dealt
    again by a hash of the whole row, and where copies of one row fill one even then, by their serials.
    """
    dealt = rows.withColumn("shard", _number(seed, "id", "size") % F.ceil(F.col("n_rows") / shard_rows))
    for step, by in enumerate((["id", "size", "key"], ["key", "serial"]), 1):
        counted = dealt.groupBy(F.col("place").alias("__place"), F.col("shard").alias("__shard")).agg(F.count("*").alias("__rows"))
        full = stored(counted.where(F.col("__rows") > 2 * shard_rows), "full-shards")
        if full.isEmpty():
            break
        piece = _number(seed, *by) % F.ceil(F.col("__rows") / shard_rows)
        # 60 bits of a hash: should two shards ever get the same number, they are one larger shard
        spread = F.when(F.col("__rows").isNull(), F.col("shard")).otherwise(_number(seed + step, "shard", piece))
        same = (F.col("place") == F.col("__place")) & (F.col("shard") == F.col("__shard"))
        dealt = dealt.join(full, same, "left").withColumn("shard", spread).drop("__place", "__shard", "__rows")
    return dealt


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    source_col: str = "source",
    text_col: str = "text",
    id_col: str = "doc_id",
    block_words: int = BLOCK_WORDS,
    shard_rows: int = SHARD_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of `docs`: id, key, source, size, source_size, target, taken, and where.

    `turns` says how often the whole text is taken; from then on its words from `from_1` up to `to_1`, and from
    `from_2` up to `to_2` (empty ranges if equal), are taken once more.  `taken` counts all of them.  Nothing is
    taken more than `most` times (rounded down).  A null or empty text has size 0 and is never taken; null sources
    are one source, the last.  Repeated rows and ids are rows of their own.  An empty table gives no rows.  Equal input and
    seed give equal results, however the rows are spread over files.
    """
    sized = sizes(docs, source_col, text_col, id_col)
    sources = stored(source_quotas(targets(sized, weights, share, most), block_words), "quotas")
    told = sources.select(F.col("source").alias("__source"), "place", "n_rows", "source_size", "target", "blocks")
    rows = sized.join(told, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = _dealt(rows, seed, shard_rows)
    shards = rows.groupBy("place", "source", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"))
    quotas = shard_quotas(shards.drop("place"))
    length, quota = F.col("words"), F.col("quota")
    blocks = F.greatest(F.lit(1), F.ceil(length / block_words))
    quotas = quotas.select(
        F.col("source").alias("__source"),
        F.col("shard").alias("__shard"),
        F.least(F.floor(quota / blocks), F.lit(int(most))).cast("long").alias("turns"),
        F.when(F.floor(quota / blocks) < int(most), quota % blocks).otherwise(0).cast("long").alias("__blocks"),
        (_number(seed, "source", "shard") % blocks * block_words).alias("__begin"),
        length.alias("__words"),
    )
    quotas = stored(quotas, "shard-quotas").withColumn("__end", F.col("__begin") + F.col("__blocks") * block_words)
    line = Window.partitionBy("place", "shard").orderBy(F.md5(_text(seed + 1, "id")), "id", "size", "key")
    at = F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = rows.withColumn("__at", at).join(
        quotas, F.col("source").eqNullSafe(F.col("__source")) & (F.col("shard") == F.col("__shard"))
    )
    # the turn's blocks are [begin, end) of the line, and go on from its start if they pass its last block
    whole = F.ceil(F.col("__words") / block_words) * block_words
    low, high = F.col("__at"), F.col("__at") + F.col("size")

    def overlap(begin: Column, end: Column) -> tuple[Column, Column]:
        first = F.least(F.greatest(low, begin), high)
        return first - low, F.greatest(first, F.least(high, end)) - low

    from_1, to_1 = overlap(F.col("__begin"), F.least(F.col("__end"), whole))
    from_2, to_2 = overlap(F.lit(0), F.greatest(F.lit(0), F.col("__end") - whole))
    return laid.select(
        "id", "key", "source", "size", "source_size", "target", "turns",
        from_1.alias("from_1"), to_1.alias("to_1"), from_2.alias("from_2"), to_2.alias("to_2"),
    ).withColumn("taken", F.col("turns") * F.col("size") + F.col("to_1") - F.col("from_1") + F.col("to_2") - F.col("from_2"))


def mixture(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The documents of the mixture, with the columns of `docs`: each as often as it is taken, parts as parts.

    Parts keep the white space before their words.  Identical rows are told apart by nothing, so what is taken of
    them together is given out to one of them.
    """
    docs, names = plain(docs)
    source_col, text_col, id_col = names[source_col], names[text_col], names[id_col]
    taken = mixed(docs, source_col=source_col, text_col=text_col, id_col=id_col, **options)
    part = F.struct("from_1", "to_1", "from_2", "to_2", "size")
    plan = taken.groupBy(F.col("id").alias("__id"), F.col("key").alias("__hash")).agg(
        F.sum("turns").alias("__turns"), F.collect_list(F.when(F.expr("to_1 > from_1 OR to_2 > from_2"), part)).alias("__parts"), F.count("*").alias("__rows"), F.sum("taken").alias("__taken")
    )
    plan = stored(plan.where("__taken > 0").drop("__taken"), "mixture")
    keyed = docs.withColumn("__key", row_key(docs))
    if not plan.where("__rows > 1").limit(1).isEmpty():
        keyed = keyed.dropDuplicates([id_col, "__key"])
    joined = keyed.join(plan, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__hash")))
    whole = F.expr("__part.size = __part.to_1 - __part.from_1 + __part.to_2 - __part.from_2")
    copies = joined.withColumn("__part", F.explode(F.concat(F.array_repeat(F.lit(None).cast(plan.schema["__parts"].dataType.elementType), F.col("__turns").cast("int")), "__parts")))
    spaced = F.regexp_extract_all(F.col(text_col), F.lit(rf"[\x20\x09-\x0D]*{WORDS}"), F.lit(0))
    cut = lambda a, b: F.array_join(F.slice(spaced, F.expr(f"CAST(__part.{a} + 1 AS INT)"), F.expr(f"CAST(__part.{b} - __part.{a} AS INT)")), "")
    text = F.when(F.col("__part").isNull() | whole, F.col(text_col)).otherwise(F.concat(cut("from_2", "to_2"), cut("from_1", "to_1")))
    return copies.withColumn(text_col, text).select(*docs.columns).toDF(*names)
