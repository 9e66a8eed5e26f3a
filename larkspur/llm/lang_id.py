"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-grams of one to four characters of the letters of a text (lower-cased, everything else a single
space) are hashed into ``buckets``. Training counts them per language, with add-one smoothing; the
matrix of log probabilities, buckets x languages, has a fixed size and is broadcast. Scoring gathers
the matrix rows of all n-grams of a batch of texts and sums them per text in numpy.

The classifier is fitted on all labelled rows that aren't held out, or if ``per_language`` is given on about so many of
each language, chosen by a hash of the id. Every row is scored
on its whole text. Language, source and id are never inputs of a prediction.

A posterior knows the learned languages only, so a text in none of them scores high as well.
``fit_floors`` gives, for each language, a floor of the mean log probability of a text's n-grams: the
FLOOR_SHARE quantile of the training rows of the language with FLOOR_CHARS or more, less FLOOR_MARGIN. A filter drops what is
under the floor of the language predicted for it.

Nulls and odd input: a text that is null or has no letter is ``und`` with score 0; rows without a
language don't train; if no row trains, every text is ``und``; a null id is never held out and
doesn't train; repeated rows train once each and are scored alike; ties go to the language that
sorts first; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import map_in_arrow

BUCKETS = 1 << 16
#: Languages that are learned, those with the most rows; the model is broadcast, half a megabyte for each.
MOST_LANGUAGES = 256
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"
FLOOR_SHARE = 0.01
FLOOR_MARGIN = 2.5
FLOOR_CHARS = 300
#: n-grams scored at once, so that a batch of long texts doesn't need more memory.
BLOCK_CHARS = 1 << 17


def held_out(id_: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


_FOLD = None


def _fold_table() -> np.ndarray:
    """Code point to its lower-case letter's code point, or to a space; for the first plane."""
    global _FOLD
    if _FOLD is None:
        table = np.full(0x10000, 32, np.uint32)
        for i in range(0x10000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low[0])
        _FOLD = table
    return _FOLD


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts in a row, and each text's length, single spaces around words."""
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    table = _fold_table()
    codes = table[np.minimum(joined, 0xFFFF)]
    high = np.flatnonzero(joined > 0xFFFF)
    if len(high):
        codes[high] = [ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in joined[high].tolist()]
    owner = np.repeat(np.arange(len(texts)), sizes)
    keep = np.ones(len(codes), bool)
    if len(codes):
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (owner[1:] != owner[:-1])
    return codes[keep], np.bincount(owner[keep], minlength=len(texts))


def hashed_ngrams(codes: np.ndarray, sizes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of each n-gram of each order; n-grams don't cross texts."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    h, out, own = np.zeros(len(codes), np.uint64), [], []
    for order in range(1, max(ORDERS) + 1):
        if len(codes) < order:
            break
        n = len(codes) - order + 1
        h = (h[:n] ^ codes[order - 1 :].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if order in ORDERS:
            inside = owner[:n] == owner[order - 1 :]
            if order == 1:
                inside &= codes != 32
            mixed = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
            out.append((mixed[inside] % np.uint64(buckets)).astype(np.int32))
            own.append(owner[:n][inside])
    if not out:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate(own)


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_CHARS characters, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def ngram_counts(labelled: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(lang, bucket, n) over the rows (text, lang), counted per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                for a, b in _blocks(own):
                    found, _ = hashed_ngrams(*letters(own[a:b]), buckets)
                    totals[lang] = totals.get(lang, 0) + np.bincount(found, minlength=buckets)
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    counted = map_in_arrow(labelled.select("text", "lang"), count, "lang string, bucket long, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int | None = None) -> tuple[list[str], DataFrame]:
    """The languages in order, and their rows (text, lang): all that may train, or a share of each language's, by one threshold each."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    below = F.lit(1_000_000) if per_language is None else F.least(F.lit(1.0), per_language / F.col("n")) * 1_000_000
    sizes = sizes.select("lang", "n", below.cast("long").alias("__below"))
    found = sizes.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).select("lang", "__below").collect()
    sizes = docs.sparkSession.createDataFrame(found, "lang string, __below long")
    langs = sorted(r.lang for r in found)
    place = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000))
    return langs, rows.join(F.broadcast(sizes), "lang").where(place < F.col("__below")).select("text", "lang")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int | None = None, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages in order and the matrix of log probabilities, languages x buckets."""
    langs, rows = training_rows(docs, id_col, text_col, lang_col, per_language)
    if not langs:
        return [], np.zeros((0, buckets), np.float32)
    counts = np.ones((len(langs), buckets))
    found = ngram_counts(rows, buckets).toPandas()
    number = {lang: i for i, lang in enumerate(langs)}
    counts[found["lang"].map(number).to_numpy(dtype=np.int64), found["bucket"].to_numpy(dtype=np.int64)] += found["n"].to_numpy(dtype=float)
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def fit_floors(
    docs: DataFrame, langs: list[str], matrix: np.ndarray, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int | None = None
) -> dict[str, float]:
    """For each language the mean log probability below which a text is taken to be in no learned language."""
    _, rows = training_rows(docs, id_col, text_col, lang_col, per_language)
    return floors_of(with_language(rows, langs, matrix, pred_col="pred", score_col="score", fit_col="fit"), "text", "lang", "pred", "fit")


def floors_of(judged: DataFrame, text_col: str, lang_col: str, pred_col: str, fit_col: str) -> dict[str, float]:
    """The floors from rows that may train and are judged already; as many as there are languages."""
    long_ones = judged.where((F.length(text_col) >= FLOOR_CHARS) & (F.col(pred_col) == F.col(lang_col)))
    low = long_ones.groupBy(F.col(lang_col).alias("lang")).agg(F.percentile_approx(fit_col, FLOOR_SHARE, 100_000).alias("low")).collect()
    return {r.lang: r.low - FLOOR_MARGIN for r in low}


def classify(texts: list[str], langs: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score (the posterior probability under equal priors) and mean log probability of an n-gram of each text."""
    names, scores, fits = [], np.zeros(len(texts)), np.zeros(len(texts))
    by_bucket = np.ascontiguousarray(matrix.T)
    for a, b in _blocks(texts):
        codes, sizes = letters(texts[a:b])
        found, own = hashed_ngrams(codes, sizes, matrix.shape[1])
        total = np.stack([np.bincount(own, weights=by_bucket[found, i], minlength=b - a) for i in range(len(langs))], axis=1) if langs else np.zeros((b - a, 0))
        n = np.bincount(own, minlength=b - a)
        has_letter = np.bincount(np.repeat(np.arange(b - a), sizes), weights=codes != 32, minlength=b - a) > 0
        for i in range(b - a):
            if not langs or not has_letter[i]:
                names.append(UNKNOWN)
                continue
            best = int(total[i].argmax())
            names.append(langs[best])
            scores[a + i] = 1 / np.exp(total[i] - total[i, best]).sum()
            fits[a + i] = total[i, best] / n[i]
    return names, scores, fits


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast((langs, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, _ = classify([t or "" for t in batch.column(1).to_pylist()], *model.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return map_in_arrow(rows, run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def with_language(
    docs: DataFrame, langs: list[str], matrix: np.ndarray, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score", fit_col: str = "lang_fit"
) -> DataFrame:
    """docs and, after its columns, the predicted language, its score and the mean log probability of an n-gram."""
    model = docs.sparkSession.sparkContext.broadcast((langs, matrix))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, fits = classify([t or "" for t in batch.column(at).to_pylist()], *model.value)
            cells = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.float64())]
            yield pa.RecordBatch.from_arrays(cells, names=[*batch.schema.names, pred_col, score_col, fit_col])

    schema = StructType([*docs.schema.fields]).add(pred_col, StringType()).add(score_col, DoubleType()).add(fit_col, DoubleType())
    return map_in_arrow(docs, run, schema)


def language_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fits on docs and returns (id, held_out, lang_pred, score) for every row."""
    langs, matrix = fit(docs, id_col, text_col, lang_col)
    out = predict(docs, langs, matrix, id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
