"""From raw documents to packed training sequences, each stage one operator of ``daybook.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next stage's documents. All but the last
return the columns of ``documents``. Tokenising isn't expressible in SQL, so there is no ``ORACLE_SQL``; the tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from daybook.operators.durable import save
from daybook.sources.tables import load

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text is rejected when no language has at least this share of the nearness.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones are in; texts without a letter and undecided ones go."""
    model = language_id.fit(docs)
    told = language_id.identify(docs, model)
    return told.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; those that were nothing else go."""
    cut = line_dedup.dedup_lines(docs)
    kept = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies. Rows that share an id stay or go together."""
    found = ngram_join.components(docs)
    gone = save(found.where("id <> component").select(F.col("id").alias("doc_id")).distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.mark(docs, load(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    import public_tokenizers

    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_join", near_duplicates), ("decontaminate", benchmarks), ("packing", sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
