"""The trie against all prefixes in a dictionary, its parts against plain sorting and hashing."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from larkspur.llm import queries
from larkspur.llm.prefix_trie import EMPTY_SHA, KEY, Run, Sequence, ends, merged, prefix_trie, shared

from ..oracle import connection, differences

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, rebuild=True):
    """Every prefix of every conversation in a dictionary."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[: 2 * KEY]
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = (own.get(c - c % 100, [])[:h] + v[h:]) if rebuild else v
    members, children = defaultdict(list), defaultdict(list)
    for c, v in seqs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, below = [], {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(below[k][0] for k in children[p]) or 1
        saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        below[p] = leaves, saved + sum(below[k][1] for k in children[p])
        ending = ",".join(str(c) for c in sorted(members[p]) if len(seqs[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), *below[p], hashlib.sha256(ending.encode()).hexdigest()))
    return ordered(out)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def conversations(seed, n, kinds=3, longest=9, copies=0.3):
    """Conversations of few texts, so that they share much; some are copies."""
    rng, rows, last = random.Random(seed), [], []
    for c in range(n):
        if not last or rng.random() > copies:
            last = [("user" if k % 2 else "assistant", "x" * rng.randrange(1, 1 + kinds)) for k in range(rng.randrange(1, longest))]
        rows += [(c, k, role, text) for k, (role, text) in enumerate(last)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("run_turns,turns_a_task,hot_rows", [(16_384, 500_000, 2_000), (12, 40, 3), (5, 15, 1)])
@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_equals_a_dictionary(spark, run_turns, turns_a_task, hot_rows, rebuild):
    rows = conversations(run_turns, 320)
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA), rebuild=rebuild, run_turns=run_turns, turns_a_task=turns_a_task, hot_rows=hot_rows)
    assert ordered(got.collect()) == plain(rows, rebuild)


def test_long_conversations_that_part_late(spark):
    """Paths deeper than the ranges look at first, cut over many tasks."""
    rows = [(100 * c + 1, k, "user", f"turn {k}" if k < 150 or k % 5 else f"{c} {k}") for c in range(12) for k in range(160 + c)]
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA), run_turns=200, turns_a_task=400, hot_rows=2)
    assert ordered(got.collect()) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "of no conversation"), (100, 1, "user", "b"), (100, None, None, None), (100, None, "user", ""), (100, 0, "user", "a"), (100, 0, "user", "a"), (100, 0, "user", "c"),
        (101, 0, "user", "long " * 100_000), (102, 0, "assistant", None), (103, 5, "user", "b"), (-5, 0, "user", "\x00é"), (205, 0, "user", "its base is absent"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    for name in ("keys", "node", "part", "chars", "count", "depth", "base"):
        df = df.withColumn(name, F.lit("clash"))
    assert ordered(prefix_trie(df).collect()) == plain(rows)
    assert prefix_trie(df.limit(0)).collect() == [] and prefix_trie(df.where("conv_id is null")).collect() == []
    only = prefix_trie(df.where("conv_id = 103")).collect()  # crc32("103") % 6 turns of a base that is absent
    assert ordered(only) == plain([r for r in rows if r[0] == 103]) and only[0].parent_conv_id is None or only[0].depth


def test_ids_of_a_large_group_are_hashed_in_chunks(spark):
    from pyspark.sql import functions as F

    members = spark.range(5_000).select(F.when(F.col("id") % 3 == 0, F.lit(b"hot")).otherwise(F.col("id").cast("string").cast("binary")).alias("seq"), (F.col("id") * 7 % 5_000).alias("conv_id"))
    want = defaultdict(list)
    for r in members.collect():
        want[bytes(r.seq)].append(r.conv_id)
    for tasks, chunk in ((1, 1 << 20), (6, 1 << 20), (6, 100)):
        got = ends(members, tasks, chunk).collect()
        assert {(bytes(r.seq), r.conv_id, r.n_ends, r.ends_sha256) for r in got} == {(s, min(i), len(i), hashlib.sha256(",".join(map(str, sorted(i))).encode()).hexdigest()) for s, i in want.items()}


def test_merge_reads_no_shared_turn_twice(monkeypatch):
    """Order and LCPs equal those of one sort; turns are compared from the known LCP on."""
    from larkspur.llm import prefix_trie as module

    rng = random.Random(4)
    keys = [bytes([i]) * KEY for i in range(3)]
    made = list({b"".join(rng.choice(keys) for _ in range(rng.randrange(40))) for _ in range(700)})
    rng.shuffle(made)
    runs = [Run.of([Sequence(k, [1] * (len(k) // KEY), 0, 1, EMPTY_SHA) for k in made[i::7]]) for i in range(7)]
    compared = []

    def counted(a, b, since=0):
        found = shared(a, b, since)
        compared.append(found - since + 1)
        return found

    monkeypatch.setattr(module, "shared", counted)
    got = list(merged(runs))
    want = sorted(made)
    assert [s.keys for s, _ in got] == want
    assert [h for _, h in got] == [0, *(shared(a, b) for a, b in zip(want, want[1:]))]
    assert sum(compared) < 2 * sum(len(k) // KEY + 1 for k in made) and len(compared) < 3 * len(made)
    assert list(merged([])) == [] and list(merged([Run.of([])])) == []


@pytest.mark.parametrize("at", [0, 1, 2, 5, 17, 63, 64, 99])
def test_shared_turns(at):
    a = bytes(range(100)) * KEY
    a = b"".join(bytes([i]) * KEY for i in range(100))
    b = a[: at * KEY] + b"\xff" * KEY + a[(at + 1) * KEY :]
    assert shared(a, b) == at and shared(a, b, at // 2) == at and shared(a, a[: at * KEY]) == at


def test_query_equals_a_dictionary_and_sql(spark, small_dir):
    got = queries.op11_prefix_trie(spark, small_dir)
    rows = spark.read.parquet(f"{small_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert ordered(got.collect()) == plain(map(tuple, rows))
    assert differences(got, connection(small_dir), queries.PREFIX_TRIE_SQL) == []
