"""A training corpus in five stages: language, lines, near duplicates, personal data, packing.

Every stage but the last returns documents, with the columns it was given; each works on all that the one
before it kept. Null and empty texts go in the first stage, as they have no language; a null source, lang or
n_chars is no reason to drop a row; further columns pass through unchanged; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from maskwright.llm import lang_id, line_dedup, near_dup, packing, pii_crf
from maskwright.llm.shared import persist

#: Dropped documents, of 16 bytes, that may be broadcast.
SMALL_LIST = 500_000
_ID, _TIE = "__corpus_pipeline_id", "__corpus_pipeline_tie"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without a text or a letter go."""
    model = lang_id.learn(lang_id.reference_texts(docs))
    return lang_id.identify(docs, model).where(F.col("lang_pred") != lang_id.UNKNOWN).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier one; a document left blank by that goes."""
    kept = line_dedup.dedup_lines(docs)
    return kept.where((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\n\r\t\v\f", "     ")) != "")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least id, or, where none has an id, of the least hash of its
    text; of rows that repeat both id and text, one."""
    named = docs.withColumn(_ID, F.col("doc_id").cast("long")).withColumn(_TIE, F.xxhash64("text"))
    found = persist(near_dup.groups(named.select(F.col(_ID).alias("id"), F.col(_TIE).alias("tie"), "text")), "groups").where("n_similar > 0")

    def chosen(rows: DataFrame, how: str) -> DataFrame:
        rows = rows.select("id", "tie").distinct()
        near = F.broadcast(rows) if rows.count() <= SMALL_LIST else rows
        return named.join(near, named[_ID].eqNullSafe(near["id"]) & (named[_TIE] == near["tie"]), how)

    first = "(id <=> keep.id and tie = keep.tie)"
    kept = chosen(found.where(f"not {first}"), "left_anti")
    repeated = persist(found.where(first).groupBy("id", "tie").count().where("count > 1").select("id", "tie"), "repeated")
    if not repeated.isEmpty():
        again = chosen(repeated, "left_semi").dropDuplicates([_ID, _TIE])
        kept = kept.join(repeated, kept[_ID].eqNullSafe(repeated["id"]) & (kept[_TIE] == repeated["tie"]), "left_anti").unionByName(again)
    return kept.select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii_crf.redact(docs, pii_crf.learn_field(docs))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of every piece of every document."""
    return packing.pack(packing.text_items(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", best_fit),
]

#: SQL can express neither the parse, nor the field, nor the packing; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = persist(stage(spark, docs, sf_dir), name)
    return docs
