"""Formatting and reading back: round trips, and figures of plain loops."""

from __future__ import annotations

import hashlib
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from larkspur.llm import queries
from larkspur.llm.chat_format import Template, chat_digests, format_chats, read_learned, read_turns, sums_before

from ..oracle import connection, differences

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(turns, t=Template()):
    """The formatted text and the learned texts of sorted turns, by a loop."""

    def safe(x):
        x = x.replace("\\", "\\\\")
        for mark in (t.turn, t.text, t.end):
            x = x.replace(mark, "\\l" + mark[1:])
        return x

    blocks = [(role, [x for _, x in g]) for role, g in groupby(turns, key=lambda x: x[0])]
    return "".join(t.turn + safe(role) + "".join(t.text + safe(x) for x in texts) + t.end for role, texts in blocks), [x for role, x in turns if role == t.learned]


def nasty(seed, n):
    rng = random.Random(seed)
    bits = ["\\", "\\\\", "<", ">", "l", "\\l", "<turn>", "<text>", "</turn>", "turn>", "\n", "é", "𝄞", "a", " ", "\x00", "$1", "<|im_start|>", "### Assistant:"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_round_trip_of_nasty_texts(spark):
    rng, rows = random.Random(1), []
    for c in range(60):
        texts = nasty(c, rng.randrange(1, 30))
        rows += [(c, k, rng.choice(["user", "assistant", "system", *nasty(k, 1)]), x) for k, x in enumerate(texts)]
    want = {c: [(r, x) for _, _, r, x in g] for c, g in groupby(rows, key=lambda r: r[0])}
    rng.shuffle(rows)
    chats = format_chats(spark.createDataFrame(rows, SCHEMA))
    got = chats.select("conv_id", "formatted", "spans", read_turns(F.col("formatted")).alias("turns"), read_learned(F.col("formatted"), F.col("spans")).alias("learned")).collect()
    assert len(got) == 60
    for r in got:
        formatted, learned = plain(want[r.conv_id])
        assert (r.formatted, r.learned, [tuple(t) for t in r.turns]) == (formatted, learned, want[r.conv_id])
        raw = r.formatted.encode()
        assert all(raw[: s.start].endswith(b"<text>") and raw[s.end :].startswith((b"<text>", b"</turn>")) for s in r.spans)


def test_digests_equal_plain_ones(spark):
    rows = [(1, k, "user" if k % 3 else "assistant", x) for k, x in enumerate(nasty(7, 50))] + [(-7, 0, "user", queries.CONTROL_TEXT), (-7, 1, "assistant", queries.CONTROL_TEXT)]
    got = {r.conv_id: r for r in chat_digests(format_chats(spark.createDataFrame(rows, SCHEMA))).collect()}
    for c, r in got.items():
        turns = [(role, x) for i, _, role, x in rows if i == c]
        formatted, learned = plain(turns)
        assert r.n_turns == len(turns) and r.formatted_chars == len(formatted) and r.loss_chars == len("".join(learned))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256("".join(learned).encode()).hexdigest()


def test_same_roles_are_merged(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e")]
    r = format_chats(spark.createDataFrame(rows, SCHEMA)).first()
    assert r.formatted == "<turn>user<text>a<text>b</turn><turn>assistant<text>c<text>d</turn><turn>user<text>e</turn>"
    assert [r.formatted[s.start : s.end] for s in r.spans] == ["c", "d"]


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "assistant", ""), (1, 0, "assistant", ""), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (None, 3, "user", "x"), (2, 0, "assistant", "y" * 3_000_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("turns", "blocks", "formatted", "spans", "x"):
        df = df.withColumn(name, F.lit("clash"))
    chats = format_chats(df)
    got = {r.conv_id: [tuple(t) for t in r.t] for r in chats.select("conv_id", read_turns(F.col("formatted")).alias("t")).collect()}
    assert got[1] == [("", ""), ("assistant", ""), ("assistant", ""), ("assistant", "a"), ("assistant", "b")] and got[None] == [("user", "x")]
    digests = {r.conv_id: r for r in chat_digests(chats).collect()}
    assert digests[2].loss_chars == 3_000_000 and digests[None].loss_chars == 0 and digests[1].n_turns == 5
    assert chat_digests(format_chats(df.limit(0))).collect() == []


def test_plan_is_expressions_only(spark, small_dir):
    plan = queries.op12_chat_format(spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1


def test_many_turns_in_one_conversation(spark):
    rows = spark.range(30_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    r = chat_digests(format_chats(rows)).first()
    assert r.n_turns == 30_000 and r.loss_sha256 == hashlib.sha256("".join(str(i) for i in range(1, 30_000, 2)).encode()).hexdigest()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101])
def test_sums_before(spark, n):
    xs = [(i * 7) % 11 for i in range(n)]
    got = spark.createDataFrame([(xs,)], "xs array<long>").select(sums_before(F.col("xs"))).first()[0]
    assert got == [sum(xs[:i]) for i in range(n)]


def test_another_template(spark):
    t = Template("<|im_start|>", "<|sep|>", "<|im_end|>", "bot")
    rows = [(1, 0, "user", "<|im_end|>\\"), (1, 1, "bot", "<turn>")]
    chats = format_chats(spark.createDataFrame(rows, SCHEMA), t)
    assert chats.select(read_turns(F.col("formatted"), t).alias("t"), read_learned(F.col("formatted"), F.col("spans")).alias("l")).first() == ([("user", "<|im_end|>\\"), ("bot", "<turn>")], ["<turn>"])
    with pytest.raises(ValueError):
        Template("a", "b", "c")


def test_query_equals_sql(spark, small_dir):
    assert differences(queries.op12_chat_format(spark, small_dir), connection(small_dir), queries.CHAT_FORMAT_SQL) == []
