"""Registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import (
    chat,
    codes,
    html_text,
    infill,
    licenses,
    mixing,
    packing,
    pii,
    quality,
    rules,
    simhash,
    topk,
    toxicity,
)
from quire.llm.common import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, directory: str) -> DataFrame:
            return function(prepare(spark), directory)

        QUERIES[function.__name__] = run
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def documents(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/documents.parquet")


def vocabulary() -> str:
    """The tokenizer's file; any other path serves the operators as well."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register(mixing.SQL)
def op1_poisson_mixing(spark: SparkSession, directory: str) -> DataFrame:
    docs = documents(spark, directory)
    mixed = mixing.mix(docs, mixing.source_rates(docs))
    return mixed.select("doc_id", "source", "lang", "n_chars", "text", F.col("copy").cast("bigint").alias("copy"), "mix_key")


@register()
def op2_contextual_pii(spark: SparkSession, directory: str) -> DataFrame:
    found = pii.found_personal_data(documents(spark, directory))
    return found.select(
        "doc_id",
        *(pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
        pii.spans_text(F.col("spans")).alias("spans"),
    )


@register()
def op3_best_fit_packing(spark: SparkSession, directory: str) -> DataFrame:
    placed = packing.packed_documents(documents(spark, directory), vocabulary())
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@register()
def op4_weak_label_quality(spark: SparkSession, directory: str) -> DataFrame:
    docs = documents(spark, directory)
    return quality.scored(docs, quality.fit(docs)).select("doc_id", "quality_score", "kept")


@register()
def op5_rare_token_licenses(spark: SparkSession, directory: str) -> DataFrame:
    return licenses.scanned(documents(spark, directory)).drop("findings")


@register()
def op6_tag_ratio_extraction(spark: SparkSession, directory: str) -> DataFrame:
    return html_text.extracted(spark.read.parquet(f"{directory}/pages.parquet"))


@register(topk.SQL)
def op7_threshold_topk(spark: SparkSession, directory: str) -> DataFrame:
    rows = spark.read.parquet(f"{directory}/embeddings.parquet").where(topk.usable(F.col("embedding")))
    vectors = rows.select("vec_id", topk.quantized(F.col("embedding")).alias("code"))
    return topk.top_products(vectors, F.col("vec_id") % 20 == 0)


@register(chat.SQL)
def op8_grammar_chat(spark: SparkSession, directory: str) -> DataFrame:
    rows = spark.read.parquet(f"{directory}/conversations.parquet").select("conv_id", "turn", "role", "text")
    same = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", same), (-7, 1, "assistant", same)], rows.schema)
    return chat.read_back(chat.formatted_turns(rows.union(extra)))


@register()
def op9_divergence_rules(spark: SparkSession, directory: str) -> DataFrame:
    return rules.judged(documents(spark, directory)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "class_distance",
        "common_distance",
    )


@register()
def op10_simhash_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, directory))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@register(infill.SQL)
def op11_sparse_index_infill(spark: SparkSession, directory: str) -> DataFrame:
    out = infill.infilled(documents(spark, directory))
    return out.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@register(codes.SQL)
def op13_hilbert_block_codes(spark: SparkSession, directory: str) -> DataFrame:
    rows = spark.read.parquet(f"{directory}/embeddings.parquet").where(topk.usable(F.col("embedding")))
    code = topk.quantized(F.col("embedding"), codes.SCALE).alias("code")
    done = codes.compressed(rows.select("vec_id", "label", code))
    return codes.with_label_error(done.codes).select(
        "vec_id",
        codes.hexadecimal(F.col("entries")).alias("code"),
        "error",
        "label_error",
        F.lit(done.digest()).alias("codebooks_sha256"),
    )


@register()
def op12_pairwise_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    docs = documents(spark, directory)
    return toxicity.scored(docs, toxicity.fit(docs, spark.read.parquet(f"{directory}/labels.parquet")))
