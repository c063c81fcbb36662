"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import bpe, decontaminate, embedding_dedup, html_text, infill, language_id, line_dedup, ngram_join, packing, quality, runs, toxicity, warc
from daybook.llm.registry import register
from daybook.llm.text import crc_mod
from daybook.sources.tables import load


@register("op7_language_id", language_id.oracle())
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = docs.withColumn("held_out", crc_mod("doc_id", 5) == 0)
    model = language_id.fit(held.where(~F.col("held_out")))
    return language_id.identify(held.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", F.round("score", 6).alias("score"))


@register("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    field = toxicity.fit(docs, load(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2))
    scored = toxicity.score(docs, field)
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "spans")


@register("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    vectors = quality.word_vectors(docs)
    net = quality.fit(docs, load(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0), vectors)
    return quality.score(docs, vectors, net).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@register("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(load(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


@register("op9_warc", warc.oracle())
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_index(load(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op6_html_text")
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(load(spark, sf_dir, "pages").select("page_id", "url", "html"))


@register("op1_line_dedup", line_dedup.oracle())
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op5_decontaminate")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", F.col("leak.item").alias("item_id"), "leak.edits", "leak.start", "leak.stop")


@register("op8_embedding_dedup", embedding_dedup.oracle())
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(load(spark, sf_dir, "embeddings"))


@register("op2_ngram_join", ngram_join.oracle())
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.components(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@register("op11_fill_in_middle", infill.oracle())
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.transform(load(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = infill.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


@register("op12_bpe")
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode(load(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(load(spark, sf_dir, "documents").select("doc_id", "text"), draw=F.crc32(F.col("doc_id").cast("string").cast("binary")))
    best = runs.strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    told = found.withColumn("best", best)
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.expr("1000L * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
