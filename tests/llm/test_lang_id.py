from __future__ import annotations

import zlib

import numpy as np
import pytest

from larkspur.llm.lang_id import classify, fit, fit_floors, hashed_ngrams, language_of, letters

from .helpers import SCHEMA, odd_documents


def rows(n: int) -> list[tuple]:
    words = {"en": "the house is over there and we go with them".split(), "de": "das haus ist dort und wir gehen mit ihnen über".split(), "fr": "la maison est là et nous allons avec eux très".split()}
    rng = np.random.default_rng(1)
    return [(i, " ".join(rng.choice(words[lang], 12)), lang, "s", 0) for i in range(n) for lang in [("en", "de", "fr")[i % 3]]]


def test_held_out_accuracy_on_driver_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = language_of(docs).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def plain_ngrams(text: str, buckets: int) -> list[int]:
    """Buckets by a loop over characters, in Python's integers: the hash of an n-gram is built letter by letter."""
    low, mask = "", (1 << 64) - 1
    for c in text:
        c = c.lower()[0] if c.isalpha() else " "
        low += "" if c == " " and low.endswith(" ") else c
    found = []
    for order in (1, 2, 3, 4):
        for i in range(len(low) - order + 1):
            if order == 1 and low[i] == " ":
                continue
            h = 0
            for c in low[i : i + order]:
                h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) & mask
                h ^= h >> 29
            found.append(((h * 0xBF58476D1CE4E5B9 & mask) >> 40) % buckets)
    return found


def test_hashed_ngrams_equal_a_plain_loop():
    for text in ("", "a", "Ab  c!d", "Größe – ÉTÉ 12 x", "\U0001d400\U00010428 ß İ", " lead", "日本"):
        assert sorted(hashed_ngrams(*letters([text]), 4096)[0].tolist()) == sorted(plain_ngrams(text, 4096)), text


def test_matrix_and_scores_equal_plain_counts(spark):
    data = rows(60)
    docs = spark.createDataFrame(data, SCHEMA)
    langs, matrix = fit(docs, buckets=512)
    counts = np.ones((3, 512))
    for i, text, lang, _, _ in data:
        if zlib.crc32(str(i).encode()) % 5:
            for b in plain_ngrams(text, 512):
                counts[langs.index(lang), b] += 1
    want = np.log(counts / counts.sum(axis=1, keepdims=True))
    assert langs == ["de", "en", "fr"] and np.allclose(matrix, want, atol=1e-5)
    texts = ["wir gehen", "the house", "", "123 !?", "là et nous"]
    names, scores, fits = classify(texts, langs, matrix)
    for text, name, score, fitted in zip(texts, names, scores, fits):
        found = plain_ngrams(text, 512)
        if not any(c.isalpha() for c in text):
            assert (name, score) == ("und", 0)
            continue
        s = np.array([matrix[k][found].astype(float).sum() for k in range(3)])
        assert name == langs[int(s.argmax())] and abs(score - 1 / np.exp(s - s.max()).sum()) < 1e-5 and abs(fitted - s.max() / len(found)) < 1e-5


def test_texts_of_no_learned_language_are_under_the_floor(spark):
    """Languages that the model hasn't seen, and random letters; all of the corpus is above."""
    from tests.conftest import DATA

    path = DATA / "sf0.01" / "documents.parquet"
    if not path.exists():
        pytest.skip("the driver's tables aren't here")
    docs = spark.read.parquet(str(path))
    langs, matrix = fit(docs)
    floors = fit_floors(docs, langs, matrix)
    rng = np.random.default_rng(3)
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem. ", "Tüm insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler. ",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto. ", "Все люди рождаются свободными и равными в своем достоинстве и правах. ",
    ]
    foreign = [t * 4 for t in foreign] + [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(80)) for _ in range(20)]
    names, _, fits = classify(foreign, langs, matrix)
    assert all(f < floors[n] for n, f in zip(names, fits)) and len(floors) == 4
    texts = [r.text for r in docs.where("n_chars > 300").select("text").collect()]
    names, _, fits = classify(texts, langs, matrix)
    assert len(texts) > 500 and all(f >= floors[n] for n, f in zip(names, fits))


def test_ngrams_do_not_cross_texts():
    one = hashed_ngrams(*letters(["ab cd"]), 1 << 16)[0]
    both, owner = hashed_ngrams(*letters(["xyz", "ab  cd", "q"]), 1 << 16)
    assert sorted(both[owner == 1].tolist()) == sorted(one.tolist())


def test_lang_source_and_id_are_no_inputs(spark):
    docs = spark.createDataFrame(rows(60), SCHEMA)
    langs, matrix = fit(docs)
    from larkspur.llm.lang_id import predict

    changed = docs.selectExpr("doc_id + 1000 as doc_id", "text", "'en' as lang", "'other' as source")
    a = [r.lang_pred for r in predict(docs, langs, matrix).orderBy("doc_id").collect()]
    assert a == [r.lang_pred for r in predict(changed, langs, matrix).orderBy("doc_id").collect()]


def test_odd_rows(spark):
    got = language_of(odd_documents(spark)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 8 and by_id[1].lang_pred == by_id[2].lang_pred == by_id[3].lang_pred == "und" and not by_id[None].held_out
    assert language_of(odd_documents(spark).limit(0)).count() == 0
    unlabelled = odd_documents(spark).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in language_of(unlabelled).collect()} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)


def test_every_row_that_may_train_does_and_gives_the_floor(spark):
    from pyspark.sql import functions as F

    from larkspur.llm.lang_id import FLOOR_MARGIN, FLOOR_SHARE, held_out, training_rows

    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.format_string("das haus %s", F.sha1((F.col("id") * 9 + k).cast("string"))) for k in range(7))).alias("text"), F.lit("de").alias("lang"))
    own = docs.where(~held_out(F.col("doc_id")))
    langs, rows = training_rows(docs)
    assert langs == ["de"] and rows.count() == own.count() > 4000
    langs, matrix = fit(docs)
    _, _, fits = classify([r.text for r in own.collect()], langs, matrix)
    assert abs(fit_floors(docs, langs, matrix)["de"] + FLOOR_MARGIN - np.sort(fits)[int(np.ceil(FLOOR_SHARE * len(fits))) - 1]) < 1e-9
