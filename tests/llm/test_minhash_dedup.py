from __future__ import annotations

import random

import numpy as np
import pytest

from larkspur.llm import minhash_dedup as m
from larkspur.llm.components import connected_components
from larkspur.llm.shingles import shingle_sets

from .helpers import documents, odd_documents, prose


def brute(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """id to (set size, component id) by comparing all pairs of plain Python sets."""
    sets = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\f\r":
            low = low.replace(c, " ")
        words = [w for w in low.split(" ") if w]
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                parent[y] = x
    return {i: (len(s), root(i)) for (i, _), s in zip(rows, sets)}


def near(words: list[str], rng: random.Random, changes: int) -> str:
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def texts_with_copies() -> list[str | None]:
    rng, texts = random.Random(4), []
    for k in range(40):
        words = prose(k, 200)
        texts.append(" ".join(words))
        texts += [near(words, rng, c) for c in (0, 1, 2, 3, 4, 6)]
    texts += [None, "", "  \n", "one two", "One  TWO", "three"]
    rng.shuffle(texts)
    return texts


def found(df) -> dict[int, tuple[int, int]]:
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_equals_brute_force(spark):
    docs = documents(spark, texts_with_copies())
    got = m.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_driver_table_equals_brute_force(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    assert found(m.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_large_nodes_and_groups_take_the_split_ways(spark, monkeypatch):
    """With small bounds every path beyond them runs: anchors, further levels, chunks, leftover blocks."""
    for name, value in (("SMALL", 4), ("ANCHORS", 2), ("SALT_ROWS", 8), ("GROUP", 6), ("BLOCK", 3)):
        monkeypatch.setattr(m, name, value)
    rng = random.Random(8)
    base = prose(77, 300)
    texts = [near(base, rng, rng.randrange(9)) for _ in range(60)] + texts_with_copies()[:40]
    docs = documents(spark, texts)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert found(m.near_duplicates(docs)) == want


def test_hot_keys_are_joined_in_place(spark, monkeypatch):
    """With a bound of two rows every key with more is hot, in components, nodes and labels alike."""
    from larkspur.llm import common

    monkeypatch.setattr(common, "HOT", 2)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    docs = documents(spark, texts_with_copies())
    assert found(m.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 99) for i in range(40)] + [(99, 39)] + [(200, i) for i in range(150, 200)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in [*range(40), 99, *range(100, 140)]} | {i: 150 for i in range(150, 201)} | {200: 150}


def test_odd_rows(spark):
    rows = m.near_duplicates(odd_documents(spark)).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == 8 and by_id[1].n_shingles == by_id[2].n_shingles == by_id[3].n_shingles == 0
    assert by_id[1].kept and by_id[2].kept and by_id[None].component_id is None and by_id[None].kept
    assert sum(r.doc_id == 5 and r.kept for r in rows) == 2
    assert m.near_duplicates(odd_documents(spark).limit(0)).count() == 0
    kept = m.drop_near_duplicates(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns and kept.count() == 8


@pytest.mark.parametrize("size", [0, 1, 4, 5, 6, 3_000])
def test_shingle_sets_have_the_size_of_plain_sets(size):
    words = prose(size, size)
    expected = brute([(0, " ".join(words))])[0][0]
    alone, between = list(shingle_sets([" ".join(words).encode()])), list(shingle_sets([b"a b", " ".join(words).encode(), b"", b"c"]))
    assert len(alone[0]) == expected and np.array_equal(alone[0], between[1])


def test_components_of_chains_stars_and_random_graphs(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    parent: dict[int, int] = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {i: root(i) for i in parent} and len(got) == len(parent)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_linked_groups_of_more_than_a_small_node(spark):
    """Two versions of a form letter, a slot a copy: every copy is nearest to anchors of its own version."""
    words = prose(77, 200)
    other = [*words[:45], "altered", *words[46:100], "changed", *words[101:]]
    rows = [" ".join([*text[:80], f"slot{i}", *text[81:]]) for i, text in enumerate([words] * 650 + [other] * 650)]
    assert len(rows) > m.SMALL
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (text.split(" ") for text in rows)]
    place = {s: k for k, s in enumerate(set().union(*shingles))}
    has = np.zeros((len(rows), len(place)), np.float32)
    for row, s in enumerate(shingles):
        has[row, [place[x] for x in s]] = 1
    common = has @ has.T
    size = has.sum(axis=1)
    linked = 100 * common >= 85 * (size[:, None] + size[None, :] - common)
    label = np.arange(len(rows))
    while (least := np.where(linked, label[None, :], len(rows)).min(axis=1)).tolist() != label.tolist():
        label = least
    assert linked[:650, 650:].any() and len(set(label.tolist())) == 1
    assert {k: v[1] for k, v in found(m.near_duplicates(documents(spark, rows))).items()} == dict(enumerate(label.tolist()))


def test_a_loose_group_of_more_than_a_small_node(spark):
    """At the production bounds: one text in 1,200 versions, from a few to a third of its words changed, against all pairs."""
    rng = random.Random(31)
    base = prose(5, 300)
    texts = [near(base, rng, rng.choice((1, 2, 4, 6, 8, 12, 20))) for _ in range(1200)]
    shingles = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.lower().split() for t in texts)]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(shingles):
        for j in range(i):
            if root(i) != root(j) and 100 * (c := len(a & shingles[j])) >= 85 * (len(a) + len(shingles[j]) - c):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    want = {i: root(i) for i in range(len(texts))}
    assert 10 < len(set(want.values())) < 1000 and len(texts) > m.SMALL
    assert {k: v[1] for k, v in found(m.near_duplicates(documents(spark, texts))).items()} == want
