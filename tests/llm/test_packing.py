from __future__ import annotations

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm.packing import Bins, best_fit, pack_documents, sequences

from .helpers import documents, odd_documents, prose

ITEM = st.tuples(st.integers(1, 20), st.integers(0, 3), st.integers(0, 4))


@settings(max_examples=200, deadline=None)
@given(st.lists(ITEM, max_size=60), st.integers(1, 3), st.booleans())
def test_always_the_tightest_compatible_bin(items, per_source, in_order):
    """Against a plain scan of all bins: the residual of the chosen bin is the least compatible one."""
    if in_order:
        items = sorted(items, reverse=True)
    bins, contents, left = Bins(20, per_source), [], []
    for size, source, cluster in items:
        fits = [
            left[b] for b, held in enumerate(contents)
            if left[b] >= size and not (cluster and any(c == cluster for _, c in held)) and not (source and sum(s == source for s, _ in held) >= per_source)
        ]
        b = bins.place(size, 1 << source if source else 0, 1 << cluster if cluster else 0)
        if b == len(contents):
            assert not fits
            contents.append([])
            left.append(20)
        else:
            assert left[b] == min(fits)
        contents[b].append((source, cluster))
        left[b] -= size
        assert left[b] == bins.left[b] >= 0


def test_one_text_of_many_sources_takes_linear_time():
    def took(n):
        began = time.perf_counter()
        bins = best_fit(np.full(n, 50), np.repeat(np.arange(1, n // 2 + 1), 2), np.full(n, 7), 2048, 4)
        assert sorted(bins) == list(range(n))
        return time.perf_counter() - began

    took(1_000)
    assert took(32_768) < 8 * took(8_192) + 0.2


@pytest.mark.parametrize("seed", range(3))
def test_hot_clusters_and_sources_choose_as_a_scan_does(seed):
    """More refusing bins than are met one by one."""
    rng = np.random.default_rng(seed)
    n, capacity, per_source = 600, 40, 2
    sizes = np.sort(rng.integers(1, 20, n))[::-1]
    sources, clusters = np.where(rng.random(n) < 0.5, 1, rng.integers(0, 9, n)), np.where(rng.random(n) < 0.4, 3, rng.integers(0, 200, n))
    got, held, left = best_fit(sizes, sources, clusters, capacity, per_source), [], []
    for size, source, cluster, b in zip(sizes.tolist(), sources.tolist(), clusters.tolist(), got):
        fits = [(left[i], i) for i, x in enumerate(held) if left[i] >= size and not (cluster and any(c == cluster for _, c in x)) and not (source and sum(s == source for s, _ in x) >= per_source)]
        assert b == (min(fits)[1] if fits else len(held))
        if b == len(held):
            held.append([])
            left.append(capacity)
        held[b].append((source, cluster))
        left[b] -= size


def test_bits_keep_values_apart():
    n = 300
    sizes, none = np.full(n, 1), np.zeros(n, np.int64)
    assert len(set(best_fit(sizes, none, np.full(n, -7), 100, 4))) == n  # one cluster: a bin each
    assert len(set(best_fit(sizes, none, np.arange(n) - 50, 100, 4))) == 3  # no conflicts: full bins
    assert len(set(best_fit(sizes, np.full(n, 9), none, 100, 4))) == n // 4


def check(rows, capacity: int, per_source: int, sources: dict, clusters: dict, words: dict):
    by_bin: dict[int, list] = {}
    for r in rows:
        by_bin.setdefault(r.bin, []).append(r)
    for held in by_bin.values():
        assert sum(r.size for r in held) == held[0].bin_size <= capacity
        assert sorted(r.position for r in held) == list(range(len(held)))
        known = [clusters[r.doc_id] for r in held if clusters[r.doc_id] is not None]
        assert len(known) == len(set(known))
        for s in {sources[r.doc_id] for r in held} - {None}:
            assert sum(sources[r.doc_id] == s for r in held) <= per_source
    for d, n in words.items():
        own = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.size for r in own) == n + 1
        assert all(a.start + a.size == b.start for a, b in zip(own, own[1:])) and own[0].start == 0


@pytest.mark.parametrize("group_rows", [7, 8192])
def test_every_word_once_and_no_conflicts(spark, group_rows):
    texts = [" ".join(prose(i // 3 if i % 2 else 99, 5 + i * 7 % 90)) for i in range(120)] + [" ".join(prose(5, 500))]
    docs = documents(spark, texts)
    rows = pack_documents(docs, capacity=100, per_source=2, group_rows=group_rows).collect()
    low = {i: tuple(t.split()) for i, t in enumerate(texts)}
    check(rows, 100, 2, {i: f"src{i % 3}" for i in low}, low, {i: len(w) for i, w in low.items()})


def test_given_clusters_and_fill(spark):
    docs = documents(spark, [" ".join(prose(i, 9)) for i in range(400)]).selectExpr("*", "doc_id % 200 as component")
    rows = pack_documents(docs.withColumn("source", F.lit(None).cast("string")), cluster_col="component", capacity=50, task_rows=1000).collect()
    check(rows, 50, 400, {i: None for i in range(400)}, {i: i % 200 for i in range(400)}, {i: 9 for i in range(400)})
    assert len({r.bin for r in rows}) <= 400 * 10 / 50 + 2


def test_few_sources_and_short_documents_fill_their_bins(spark):
    docs = documents(spark, [" ".join(prose(i, 20 + i % 30)) for i in range(2000)]).withColumn("source", F.lit("one"))
    rows = pack_documents(docs).collect()
    sizes = {r.bin: r.bin_size for r in rows}
    assert sum(sizes.values()) > 0.9 * 2048 * len(sizes) and sum(r.size for r in rows) == sum(21 + i % 30 for i in range(2000))


def test_sequences_hold_every_token_once(spark):
    """By token counts, with near-duplicate components as clusters; each sequence is cut from the documents' ids."""
    from larkspur.llm.bpe import bpe_encode
    from larkspur.llm.minhash_dedup import near_duplicates
    from larkspur.llm.queries import tokenizer

    base = prose(3, 80)
    docs = documents(spark, [" ".join(prose(i, 5 + i * 37 % 150)) for i in range(90)] + [" ".join([*base[:40], f"x{i}", *base[41:]]) for i in range(10)] + [None])
    encoded = bpe_encode(docs, *tokenizer())
    sized = docs.join(encoded, "doc_id").join(near_duplicates(docs).select("doc_id", "component_id"), "doc_id").withColumn("n", F.size("ids"))
    placed = pack_documents(sized, cluster_col="component_id", size_col="n", capacity=256, per_source=3)
    rows, ids = placed.collect(), {r.doc_id: list(r.ids) for r in encoded.collect()}
    component = {r.doc_id: r.component_id for r in sized.collect()}
    check(rows, 256, 3, {i: f"src{i % 3}" for i in ids}, component, {i: len(x) for i, x in ids.items()})
    want: dict = {}
    for r in sorted(rows, key=lambda r: (r.bin, r.position)):
        want.setdefault(r.bin, []).extend([*ids[r.doc_id], -1][r.start : r.start + r.size])
    got = {r.bin: list(r.units) for r in sequences(sized, placed, "ids", F.lit(-1)).collect()}
    assert got == want and max(map(len, got.values())) <= 256 and len({component[i] for i in range(90, 100)}) == 1


def test_odd_rows(spark):
    rows = pack_documents(odd_documents(spark)).collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[1][0].size == by_id[2][0].size == by_id[3][0].size == 1
    assert sum(r.size for r in by_id[4]) == 60_001 and len(by_id[5]) == 2 and by_id[5][0].bin != by_id[5][1].bin and None in by_id
    assert pack_documents(odd_documents(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack_documents(odd_documents(spark), capacity=0)
