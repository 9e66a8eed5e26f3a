"""Chat formatting by Spark expressions only: sort collected turns, merge those of one role, concatenate.

The rows of a conversation are collected as structs and sorted by turn. Adjacent turns of one role
are merged into a block (role, texts). A block becomes

    <turn>role<text>first text<text>second text</turn>

and a conversation its blocks, one after the other. Inside roles and texts a backslash becomes two,
and the ``<`` of any control string becomes ``\\l``, so control strings stand where the template put
them and nowhere else, and ``read_turns`` gives the rows back exactly, merged or not.

The loss mask is a list of spans, byte offsets in the UTF-8 form: one for each text of the role that
is learned, without the marks around it. Bytes, as a span is then cut out in constant time.

All work on a conversation is linear in its length, but for the offsets, n sqrt(n) in its turns.
Values that a lambda reads are bound once by ``let``, as the optimizer may else put an expression
inside a loop. A conversation is a row of the result, so it must fit in one (2 GB).

Nulls and odd input: a null role or text is an empty one; null turns come first; turns with the same
number are ordered by role, then text, and repeated rows are turns of their own; rows with a null id
make one conversation of that id; other columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"
#: What an escaped ``<`` is written as.
ESCAPED_MARK = ESCAPE + "l"


@dataclass(frozen=True)
class Template:
    """Control strings and the role that is learned; each control string has one ``<``, at its start, and no backslash."""

    turn: str = "<turn>"
    text: str = "<text>"
    end: str = "</turn>"
    learned: str = "assistant"

    def __post_init__(self) -> None:
        marks = (self.turn, self.text, self.end)
        if any(len(m) < 2 or m.rfind("<") or ESCAPE in m for m in marks) or any(a.startswith(b) for a in marks for b in marks if a is not b):
            raise ValueError(f"no control strings: {marks}")

    def escaped(self, text: Column) -> Column:
        text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
        for mark in (self.turn, self.text, self.end):
            text = F.replace(text, F.lit(mark), F.lit(ESCAPED_MARK + mark[1:]))
        return text


TEMPLATE = Template()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body reads it."""
    return F.transform(F.array(value), body)[0]


def unescaped(text: Column) -> Column:
    """The inverse of ``Template.escaped``: pairs of backslashes part the text, so any other backslash begins an escaped mark."""
    return F.array_join(F.transform(F.split(text, r"\\\\"), lambda part: F.replace(part, F.lit(ESCAPED_MARK), F.lit("<"))), ESCAPE)


def sums_before(sizes: Column) -> Column:
    """For each element of an array of longs the sum of those before it, in chunks of about sqrt(n)."""

    def within(chunk: Column, start: Column) -> Column:
        first = F.struct(F.array().cast("array<bigint>").alias("found"), start.cast("bigint").alias("at"))
        step = lambda a, x: F.struct(F.concat(a["found"], F.array(a["at"])).alias("found"), (a["at"] + x).alias("at"))
        return F.aggregate(chunk, first, step)["found"]

    total = lambda chunk: F.aggregate(chunk, F.lit(0).cast("bigint"), lambda a, x: a + x)
    cut = lambda all_, width: F.transform(F.sequence(F.lit(1), F.size(all_), width), lambda i: F.slice(all_, i, width))
    joined = lambda chunks: F.flatten(F.zip_with(chunks, within(F.transform(chunks, total), F.lit(0)), within))
    return let(sizes, lambda all_: let(F.ceil(F.sqrt(F.size(all_))).cast("int"), lambda width: let(cut(all_, width), joined)))


def merged(turns: Column) -> Column:
    """Sorted structs (turn, role, text) as blocks (role, texts) of adjacent turns of one role."""

    def blocks(t: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(t) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
        return let(starts, lambda s: F.zip_with(s, F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(t))), block(t)))

    def block(t: Column) -> Callable[[Column, Column], Column]:
        texts = lambda a, b: F.transform(F.slice(t, a + 1, b - a), lambda x: x["text"])
        return lambda a, b: F.struct(F.get(t, a)["role"].alias("role"), texts(a, b).alias("texts"))

    return let(turns, blocks)


def collected(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, blocks): the merged turns of every conversation."""
    empty = F.lit("")
    turn = F.struct(df[turn_col].alias("turn"), F.coalesce(df[role_col], empty).alias("role"), F.coalesce(df[text_col], empty).alias("text"))
    turns = df.select(df[conv_col].alias("conv_id"), turn.alias("turn")).groupBy("conv_id").agg(F.collect_list("turn").alias("turns"))
    return turns.select("conv_id", merged(F.sort_array("turns")).alias("blocks"))


def format_chats(df: DataFrame, template: Template = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, spans): every conversation as a string, and where its learned texts are, as (start, end) in bytes."""
    t = template
    safe = lambda b: F.struct(t.escaped(b["role"]).alias("role"), F.transform(b["texts"], t.escaped).alias("texts"), (b["role"] == t.learned).alias("learned"))
    rows = collected(df, conv_col, turn_col, role_col, text_col).select("conv_id", F.transform("blocks", safe).alias("blocks"))
    whole = lambda b: F.concat(F.lit(t.turn), b["role"], F.lit(t.text), F.array_join(b["texts"], t.text), F.lit(t.end))
    size = lambda x: F.octet_length(x).cast("bigint")
    opened = lambda b: size(b["role"]) + len((t.turn + t.text).encode())

    def pieces(b: Column) -> Column:
        """(mark, text, learned): bytes before each text of a block and bytes of it, then the bytes of its end."""
        texts = F.transform(b["texts"], lambda x, i: F.struct(F.when(i == 0, opened(b)).otherwise(len(t.text.encode())).alias("mark"), size(x).alias("text"), b["learned"].alias("learned")))
        end = F.struct(F.lit(len(t.end.encode())).cast("bigint").alias("mark"), F.lit(0).cast("bigint").alias("text"), F.lit(False).alias("learned"))
        return F.concat(texts, F.array(end))

    def spans(p: Column) -> Column:
        at = F.zip_with(p, sums_before(F.transform(p, lambda x: x["mark"] + x["text"])), lambda x, before: F.struct((before + x["mark"]).alias("start"), (before + x["mark"] + x["text"]).alias("end"), x["learned"].alias("learned")))
        return F.transform(F.filter(at, lambda s: s["learned"]), lambda s: F.struct(s["start"], s["end"]))

    return rows.select(
        "conv_id", let(F.col("blocks"), lambda b: F.struct(F.array_join(F.transform(b, whole), "").alias("formatted"), let(F.flatten(F.transform(b, pieces)), spans).alias("spans"))).alias("x")
    ).select("conv_id", "x.formatted", "x.spans")


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns (role, text) that a formatted conversation was made of, in order."""

    def rows(fields: Column) -> Column:
        return let(unescaped(fields[0]), lambda role: F.transform(F.slice(fields, F.lit(2), F.size(fields)), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text"))))

    bodies = F.filter(F.split(formatted, _literal(template.end)), lambda b: b != "")
    return F.flatten(F.transform(bodies, lambda b: let(F.split(F.substr(b, F.lit(len(template.turn) + 1)), _literal(template.text)), rows)))


def read_learned(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return let(formatted.cast("binary"), lambda data: F.transform(spans, lambda s: unescaped(F.substr(data, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string"))))


def _literal(mark: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c.isascii() else c for c in mark)


def chat_digests(chats: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from what ``format_chats`` gave."""
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    read = let(read_turns(F.col("formatted"), template), lambda t: F.struct(F.size(t).cast("bigint").alias("n_turns"), F.sha2(F.array_join(F.transform(t, line), ""), 256).alias("turns_sha256")))
    learned = let(F.array_join(read_learned(F.col("formatted"), F.col("spans")), ""), lambda x: F.struct(F.length(x).cast("bigint").alias("loss_chars"), F.sha2(x, 256).alias("loss_sha256")))
    return chats.select("conv_id", read.alias("read"), learned.alias("learned"), F.length("formatted").cast("bigint").alias("formatted_chars")).select("conv_id", "read.*", "learned.*", "formatted_chars")
