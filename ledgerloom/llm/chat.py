"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar:  conversation := turn*     turn := "<turn:" role ">\\n" text "</turn>\\n"

A rendered turn is parsed again and compared with its source; where that differs, the role and text are escaped
("\\" -> "\\s", "<" -> "\\l", ">" -> "\\g"), so that text without conflicts stays as it is. Then the whole conversation is parsed and its turns
are compared with the source; should they differ, all of its turns are escaped, and what still differs is an error. Parsing reads
turns up to each "</turn>\\n" and undoes escapes. The loss mask is ranges of the formatted text: the texts of assistant turns as they stand there.

Defined cases: null roles and texts are empty; rows are ordered by turn (nulls first), then role and text; repeated rows
are turns of their own; a null conv_id is a conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "<turn:", ">\n", "</turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    """In escaped text each backslash is followed by s, l or g, so the order of the steps doesn't matter but for the last."""
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\s"), F.lit("\\"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MID), text, F.lit(CLOSE))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pieces(formatted: Column) -> Column:
    """What stands before each end of a turn."""
    return _let(F.split(formatted, r"</turn>\n", -1), lambda p: F.slice(p, 1, F.size(p) - 1))


def _role(piece: Column) -> Column:
    return unescape(F.substring(piece, F.lit(len(OPEN) + 1), F.instr(piece, MID) - 1 - len(OPEN)))


def parse(formatted: Column) -> Column:
    """The turns of formatted text: array of struct(role, text)."""

    def turn(p: Column) -> Column:
        return F.struct(_role(p).alias("role"), unescape(F.substring(p, F.instr(p, MID) + len(MID), F.length(p))).alias("text"))

    return F.transform(_pieces(formatted), turn)


def loss_mask(formatted: Column) -> Column:
    """The ranges [start, end) of the formatted text, in characters, that training counts: the texts of assistant turns."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.instr(p, MID) - 1 + len(MID)
        here = F.array(F.struct(begin.cast("int").alias("start"), (acc["at"] + F.length(p)).cast("int").alias("end")))
        return F.struct((acc["at"] + F.length(p) + len(CLOSE)).cast("int").alias("at"), F.when(_role(p) == "assistant", F.concat(acc["mask"], here)).otherwise(acc["mask"]).alias("mask"))

    return F.aggregate(_pieces(formatted), F.struct(F.lit(0).alias("at"), none.alias("mask")), step, lambda acc: acc["mask"])


def render_turn(role: Column, text: Column) -> Column:
    """The rendered turn, escaped if its plain rendering does not read back as the same single turn."""

    def checked(plain: Column) -> Column:
        same = parse(plain) == F.array(F.struct(role.alias("role"), text.alias("text")))
        return F.when(same, plain).otherwise(render(escape(role), escape(text)))

    return _let(render(role, text), checked)


def _whole(t: Column) -> Column:
    """A conversation's formatted text, of which parsing gives the turns of its source."""
    source = F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    wrong = F.raise_error(F.lit("a conversation does not read back")).cast("string")
    escaped = F.array_join(F.transform(t, lambda x: render(escape(x["role"]), escape(x["text"]))), "")
    return _let(F.array_join(F.transform(t, lambda x: x["piece"]), ""), lambda f: F.when(parse(f) == source, f).otherwise(_let(escaped, lambda g: F.when(parse(g) == source, g).otherwise(wrong))))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id and formatted text of each conversation; turns has conv_id, turn, role, text."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv_id", F.struct("turn", "role", "text", render_turn(F.col("role"), F.col("text")).alias("piece")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", _whole(F.col("t")).alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted text says: its turns, the loss mask, and the text under the mask with escapes undone."""
    mine = formatted.withColumn("turns", parse(F.col("formatted"))).withColumn("mask", loss_mask(F.col("formatted")))
    return mine.withColumn("loss", F.array_join(F.transform("mask", lambda m: unescape(F.substring("formatted", m["start"] + 1, m["end"] - m["start"]))), ""))
