"""From raw documents to packed training sequences: language, toxicity, near duplicates, packing.

Each stage gets the documents that its predecessor kept. All but the last return them with the columns they came with, whatever further columns
those are and whatever their names.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidymill.llm import jaccard, language, packing, toxicity
from tidymill.llm.frames import pick, stored, table, whole_text

#: A text whose pooled probability is below this is in no language that was learned.
LEAST_SCORE = 0.35
READ = ("doc_id", "text", "lang")


def _carried(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """All columns under names that clash with nothing, and doc_id, text and lang beside them."""
    own = tuple(f"c{i}" for i in range(len(docs.columns)))
    named = [F.col(own[docs.columns.index(c)]).alias(c) for c in READ if c in docs.columns]
    return docs.toDF(*own).select(*own, *named), own


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and texts in none of the learned languages, go."""
    rows, own = _carried(docs)
    found = language.predict(rows, language.train(rows), keep=own)
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*own).toDF(*docs.columns)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    rows, own = _carried(docs)
    found = toxicity.score(rows, toxicity.train(rows, table(spark, sf_dir, "labels")), keep=own)
    return found.filter("predicted = 0").select(*own).toDF(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class by doc_id stays, once."""
    rows, own = _carried(docs)
    kept = jaccard.near_duplicates(pick(rows, "doc_id", "text")).filter("kept").select(F.col("doc_id").alias("id"), "mark").distinct()
    marked = rows.withColumn("mark", F.xxhash64(whole_text()))
    found = marked.join(kept, marked["doc_id"].eqNullSafe(kept["id"]) & (marked["mark"] == kept["mark"]), "left_semi")
    return found.dropDuplicates(["doc_id", "mark"]).select(*own).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("language_id", identify_language), ("toxicity", remove_toxic), ("ngram_jaccard_join", remove_near_duplicates), ("best_fit_packing", pack_sequences)]

#: The classifiers have no SQL form; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
