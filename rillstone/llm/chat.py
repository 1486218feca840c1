"""Chat formatting that survives its own parser.

Turns are rendered as `<|im_start|>role`, a line end, the text, `<|im_end|>` and a line end.  The rendered text is
parsed again by the grammar alone, and the turns it gives are compared to the source.  Where they differ, the turns whose content
conflicts with the grammar are escaped, and the result is parsed and compared again; should it still differ, every turn
is escaped.  An escape puts a backslash between `<` and `|` (and one more where backslashes stand there already), so it can be
undone wherever it was applied, and after it no control string is left.  All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cuts, folded_before, let

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
#: The role whose texts the loss covers.
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role_out(role: Column) -> Column:
    """Roles stand on one line: line ends and backslashes are written as two characters."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    parts = F.split(unescaped(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))


def _rendered(turns: Column, escape) -> Column:
    text = lambda t: F.when(escape(t), escaped(t["text"])).otherwise(t["text"])
    return F.array_join(F.transform(turns, lambda t: _turn(_role_out(t["role"]), text(t))), "")


def parsed(formatted: Column) -> Column:
    """array<(role, text, start, length)> of a formatted conversation; null where the grammar is broken.

    A turn ends at the first end mark and has its start mark at its beginning and nowhere else.  `start` (from 0) and
    `length` give the place of the text as it is written, in code points; role and text are unescaped.
    """
    def read(body: Column, at: Column) -> Column:
        line = F.locate("\n", body)
        inside = F.substring(body, F.lit(len(START) + 1), F.greatest(line - len(START) - 1, F.lit(0)))
        text = F.substring(body, line + 1, F.length(body))
        sound = F.startswith(body, F.lit(START)) & (line > len(START)) & ~F.contains(F.substring(body, F.lit(2), F.length(body)), F.lit(START)) & ~F.contains(body, F.lit(END))
        turn = F.struct(
            _role_in(inside).alias("role"), unescaped(text).alias("text"), (at + line).cast("long").alias("start"), F.length(text).cast("long").alias("length")
        )
        return F.struct(F.coalesce(sound, F.lit(False)).alias("sound"), turn.alias("turn"))

    def turns(found: Column) -> Column:
        return F.when(F.forall(found, lambda x: x["sound"]), F.transform(found, lambda x: x["turn"]))

    def of_bodies(bodies: Column) -> Column:
        places = folded_before(F.transform(bodies, lambda b: F.length(b) + len(END) + 1), lambda a, x: a + x)
        return let(F.zip_with(bodies, places, read), turns)

    def of_pieces(pieces: Column) -> Column:
        bodies = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
        return F.when(F.element_at(pieces, -1) == "", let(bodies, of_bodies))

    return let(F.split(formatted, rf"{_quoted(END)}\n", -1), of_pieces)


def _quoted(mark: str) -> str:
    return mark.replace("|", r"\|")


def _same(turns: Column, formatted: Column) -> Column:
    """Whether parsing gives the source back."""
    back = F.transform(parsed(formatted), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return F.coalesce(back == turns, F.lit(False))


def formatted(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation id, formatted, escapes): one row per conversation, null ids together as one.

    Turns follow `turn_col` (nulls last), then role and text, so repeated turns have a defined order and all stay.
    Null roles and texts are empty.  `escapes` says what the round trip asked for: 0 nothing, 1 the conflicting turns,
    2 all turns.  Other columns are left out; an empty table gives no rows.  A conversation is one string, so its
    turns meet in one row; nothing else does.
    """
    turn = F.struct(
        F.col(turn_col).isNull().alias("missing"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    grouped = rows.groupBy(F.col(conv_col).alias(conv_col)).agg(F.array_sort(F.collect_list(turn)).alias("__turns"))
    grouped = grouped.withColumn("__turns", F.transform("__turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    conflicts = lambda t: t["text"].rlike(rf"{_quoted(START)}|{_quoted(END)}|<\\+\|")
    rungs = [lambda t: F.lit(False), conflicts, lambda t: F.lit(True)]
    out = grouped.withColumn("formatted", _rendered(F.col("__turns"), rungs[0])).withColumn("escapes", F.lit(0))
    for step, escape in enumerate(rungs[1:], 1):
        out = out.withColumn("__same", _same(F.col("__turns"), F.col("formatted")))
        again = F.when(F.col("__same"), F.col("formatted")).otherwise(_rendered(F.col("__turns"), escape))
        out = out.withColumn("formatted", again).withColumn("escapes", F.when(F.col("__same"), F.col("escapes")).otherwise(step))
    return out.select(conv_col, "formatted", "escapes")


def with_mask(chats: DataFrame) -> DataFrame:
    """Adds `turns` as parsed back, and `mask`: the places (start, length) of the learned texts in `formatted`."""
    chats = chats.withColumn("turns", parsed(F.col("formatted")))
    learned = F.filter("turns", lambda t: t["role"] == LEARNED)
    return chats.withColumn("mask", F.transform(learned, lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))))


def learned_text(formatted: Column, mask: Column) -> Column:
    """The texts under the mask, unescaped, one after the other."""
    return F.array_join(F.transform(cuts(formatted, mask), unescaped), "")
