"""From raw documents to packed training sequences: five stages, each on all that its predecessor kept.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last one with
the columns of documents. Between stages the rows are written as Parquet in the shared folder.

Nulls and odd input: a null text has no words and fails the quality rules; columns beyond those of
documents stay until packing, which returns columns of its own; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import materialize, table
from larkspur.llm.lang_id import UNKNOWN, fit, floors_of, held_out, with_language
from larkspur.llm.minhash_dedup import drop_near_duplicates
from larkspur.llm.packing import pack_documents
from larkspur.llm.pii import redact
from larkspur.llm.quality import quality_filter

#: A document stays if its predicted language is one the corpus is labelled with, at this posterior or
#: more, and its n-grams are as likely in that language as such texts' are.
LANGUAGE_AT = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are more likely good than bad."""
    return quality_filter(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the corpus's languages; lang becomes the predicted one."""
    langs, matrix = fit(docs)
    if not langs:
        return docs.limit(0)
    columns = [F.col("__lang_pred").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns]
    judged = materialize(with_language(docs, langs, matrix, pred_col="__lang_pred", score_col="__lang_score", fit_col="__lang_fit"), "judged")
    floors = floors_of(judged.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), "text", "lang", "__lang_pred", "__lang_fit")
    floor = F.coalesce(*(F.when(F.col("__lang_pred") == lang, x) for lang, x in sorted(floors.items())), F.lit(float("-inf")))
    known = (F.col("__lang_pred") != UNKNOWN) & (F.col("__lang_score") >= LANGUAGE_AT) & (F.col("__lang_fit") >= floor)
    return judged.where(known).select(*columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return drop_near_duplicates(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in the text replaced by its kind; n_chars is that of the new text."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document, or piece of a long one, goes: (doc_id, piece, start, size, bin, position, bin_size)."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("minhash_dedup", dedup_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: Training a classifier, trees of minwise tokens and best fit aren't SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
