"""The queries with SQL against DuckDB, and the pipeline against plain versions of its stages."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import lang_id, queries
from tests.oracle import connection, differences

from .helpers import odd_documents
from .test_lang_id import plain_ngrams
from .test_minhash_dedup import brute as near_brute
from .test_packing import check
from .test_pii import brute_redacted
from .test_quality import plain_kept


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, small_dir, name):
    assert differences(queries.queries()[name](spark, small_dir), connection(small_dir), queries.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_covers_its_table(spark, small_dir, name):
    table, key = ("pages", "page_id") if name.startswith(("op3_", "op10_")) else ("documents", "doc_id")
    out = queries.queries()[name](spark, small_dir)
    assert out.select(key).distinct().count() == spark.read.parquet(f"{small_dir}/{table}.parquet").count()


FOREIGN = (
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. "
    "Każda osoba posiada wszystkie prawa i wolności zawarte w niniejszej deklaracji bez względu na różnice rasy, koloru, płci, języka, wyznania, poglądów politycznych lub innych "
    "przekonań, narodowości, pochodzenia społecznego, majątku, urodzenia albo jakiekolwiek inne różnice. Nie wolno nikogo czynić niewolnikiem ani nakładać na nikogo służebności. "
    "Nikt nie może być poddany torturom lub okrutnemu, nieludzkiemu czy poniżającemu traktowaniu bądź karaniu. Wszyscy są równi wobec prawa i mają prawo do jednakowej ochrony prawnej, numer "
)


def plain_languages(rows) -> dict:
    """id to language of the rows that the language stage keeps: naive Bayes and its floors by loops over n-grams."""
    grams = {r.doc_id: np.bincount(plain_ngrams(r.text, lang_id.BUCKETS), minlength=lang_id.BUCKETS) for r in rows}
    train = [r for r in rows if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    langs = sorted({r.lang for r in train})
    counts = np.array([1 + sum(grams[r.doc_id] for r in train if r.lang == x) for x in langs], float)
    log = np.log(counts / counts.sum(axis=1, keepdims=True))
    total = {i: log @ g for i, g in grams.items()}
    best = {i: int(t.argmax()) for i, t in total.items()}
    fits = {i: total[i][best[i]] / grams[i].sum() for i in best}
    floors = {}
    for k, x in enumerate(langs):
        own = sorted(fits[r.doc_id] for r in train if r.lang == x and best[r.doc_id] == k and len(r.text) >= lang_id.FLOOR_CHARS)
        floors[k] = own[math.ceil(lang_id.FLOOR_SHARE * len(own)) - 1] - lang_id.FLOOR_MARGIN
    return {i: langs[k] for i, k in best.items() if fits[i] >= floors[k] and 1 / np.exp(total[i] - total[i].max()).sum() >= 0.5}


def test_pipeline_equals_plain_stages(spark, small_dir):
    """Each stage against a brute-force version of it on what the stage before kept."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    foreign = spark.createDataFrame([(10**6 + k, FOREIGN + f"{k}", None, "src0", len(FOREIGN) + 1) for k in range(3)], docs.schema)
    columns, state = docs.columns, docs.unionByName(foreign)
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in state.collect()}
        state = stage(spark, state, small_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert state.columns == columns
            state = spark.createDataFrame(state.collect(), docs.schema)
            kept.append((before, {r.doc_id: r for r in state.collect()}))
    quality, language, dedup, pii = kept
    assert quality[1] == {i: quality[0][i] for i in plain_kept({i: r.text for i, r in quality[0].items()})} and 0 < len(quality[1]) < len(quality[0])
    known = plain_languages(language[0].values())
    assert {i: r.lang for i, r in language[1].items()} == known and all(i < 10**6 for i in known) and len(language[0]) - len(known) == 3
    assert all(r.text == language[0][i].text and r.source == language[0][i].source for i, r in language[1].items())
    groups = near_brute([(i, r.text) for i, r in dedup[0].items()])
    assert dedup[1] == {i: dedup[0][i] for i, (_, component) in groups.items() if i == component} and len(dedup[1]) < len(dedup[0])
    assert {i: (r.text, r.n_chars) for i, r in pii[1].items()} == {i: (t := brute_redacted(r.text), len(t)) for i, r in pii[0].items()}
    assert any(r.text != pii[0][i].text for i, r in pii[1].items())
    rows = state.collect()
    low = {i: tuple(r.text.lower().split()) for i, r in pii[1].items()}
    sources = [r.source for r in pii[1].values()]
    most = max(4, math.ceil(2 * max(map(sources.count, sources)) / math.ceil(sum(len(w) + 1 for w in low.values()) / 2048)))
    check(rows, 2048, most, {i: r.source for i, r in pii[1].items()}, low, {i: len(w) for i, w in low.items()})


def test_run_applies_every_stage(spark, small_dir):
    state = spark.read.parquet(f"{small_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, small_dir)
    whole = corpus_pipeline.run(spark, small_dir)
    place = lambda df: {(r.doc_id, r.piece, r.size) for r in df.collect()}
    assert place(whole) == place(state)


def test_stages_take_odd_rows(spark, small_dir):
    """Which ids each stage keeps of the odd rows, of an empty table, and of texts that are all null."""
    want = {"quality_rules": [4], "language_id": [None, 4, 5, 5], "minhash_dedup": [None, 1, 2, 3, 4, 5, 5, 6], "pii": [None, 1, 2, 3, 4, 5, 5, 6]}
    for name, stage in corpus_pipeline.STAGES:
        odd = odd_documents(spark)
        ids = sorted((r.doc_id for r in stage(spark, odd, small_dir).collect()), key=lambda x: (x is not None, x))
        nulls = stage(spark, odd.withColumn("text", F.lit(None).cast("string")), small_dir)
        if name == "best_fit_packing":
            assert {i: ids.count(i) for i in set(ids)} == {None: 1, 1: 1, 2: 1, 3: 1, 4: 30, 5: 2, 6: 1} and [r.size for r in nulls.collect()] == [1] * 8
        else:
            assert ids == want[name] and stage(spark, odd, small_dir).columns == odd.columns
            assert nulls.count() == (0 if name in ("quality_rules", "language_id") else 8)
        assert stage(spark, odd.limit(0), small_dir).count() == 0
