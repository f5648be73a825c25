"""Engine inputs derived from the given tables by fixed formulas (see FIXTURES.md).

Every function reads whole tables. ``checks.ctes`` states the same formulas for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import claims as C
from quire.operators import layout as L
from quire.operators.scan import position_in_unit
from quire.session import materialize


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-bound work enough partitions when a table has only a few row groups.

    Larger tables are scanned in more partitions than there are cores and are not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def layout_blocks(spark: SparkSession, directory: str) -> DataFrame:
    """One block per line of each document, with headings and citations added by formula."""
    lines = spread(table(spark, directory, "documents")).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")
    )
    return lines.withColumn("k", F.expr("(doc_id * 7 + i * 3) % 16")).select(
        F.col("doc_id").alias("artifact_id"),
        F.expr("CAST(i DIV 8 + 1 AS INT)").alias("page_no"),
        F.expr("CAST(i % 8 AS INT)").alias("ordinal"),
        F.expr(
            "CASE WHEN i = 0 THEN 'doc_title' WHEN k = 1 THEN 'paragraph_title'"
            " WHEN k = 2 THEN 'table' WHEN k IN (3, 6) THEN 'figure_title'"
            " WHEN k IN (0, 4, 9) THEN 'image' WHEN k = 5 THEN 'header'"
            " WHEN k = 7 THEN 'table_title' WHEN k = 13 THEN 'display_formula'"
            " ELSE 'text' END"
        ).alias("label"),
        F.expr(
            "concat("
            "CASE WHEN i > 0 AND k = 1 THEN concat(CAST(i % 9 + 1 AS STRING),"
            " CASE i % 3 WHEN 0 THEN '' WHEN 1 THEN '.1' ELSE '.1.1' END, ' ') ELSE '' END,"
            " line,"
            " CASE WHEN i = 0 THEN '' WHEN k IN (8, 12) THEN concat(' [', i + 1, ']')"
            " WHEN k = 10 THEN ' (Nguyen, 2020) [3, 4]' WHEN k = 11 THEN ' 😀 [3] [3]'"
            " ELSE '' END)"
        ).alias("content"),
        F.expr("CAST(i * 37 % 200 AS DOUBLE)").alias("x0"),
        F.expr("CAST(i % 8 * 100 AS DOUBLE)").alias("y0"),
        F.expr("CAST(i * 37 % 200 + 100 + i % 5 * 60 AS DOUBLE)").alias("x1"),
        F.expr("CAST(i % 8 * 100 + 80 AS DOUBLE)").alias("y1"),
    )


def damaged_blocks(spark: SparkSession, directory: str) -> DataFrame:
    """The same blocks, some with a box whose right edge lies left of its left edge."""
    line = (F.col("page_no") - 1) * 8 + F.col("ordinal")
    bad = (F.col("artifact_id") * 5 + line) % 97 == 0
    return layout_blocks(spark, directory).withColumn(
        "x1", F.when(bad, F.col("x0") - 1).otherwise(F.col("x1"))
    )


def layout_pages(blocks: DataFrame) -> DataFrame:
    """The pages a layout reader would give for these blocks, eight blocks to a page."""
    block = F.struct(
        F.col("label").alias("block_label"),
        F.col("content").alias("block_content"),
        F.array("x0", "y0", "x1", "y1").alias("block_bbox"),
    )
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", block.alias("block")))), lambda b: b["block"]
    )
    return (
        blocks.groupBy("artifact_id", "page_no")
        .agg(listed.alias("parsing_res_list"))
        .select(
            "artifact_id",
            "page_no",
            F.to_json(F.struct("parsing_res_list")).alias("page_json"),
        )
    )


def parsed_blocks(spark: SparkSession, directory: str) -> DataFrame:
    """Blocks with type, exclusion flag, markers, order, section and external id, as a table."""
    typed = L.flag_claim_exclusion(L.map_block_type(layout_blocks(spark, directory)))
    return materialize(L.block_external_ids(L.order_and_assign(L.extract_citations(typed))))


def candidates(spark: SparkSession, directory: str) -> DataFrame:
    """Grouped claim candidates of the parsed blocks."""
    return C.group_section_text(C.claim_candidates(parsed_blocks(spark, directory)))


CLAIM_BATCH_CHARS = C.MAX_BATCH_CHARS
MODEL = "model-a"


def batched_candidates(spark: SparkSession, directory: str, max_chars: int) -> DataFrame:
    return C.batch_section_text(candidates(spark, directory), max_chars)[0]


def claim_rows(batched: DataFrame, faulty: bool) -> DataFrame:
    """One claim per candidate block; with ``faulty`` some break one rule each."""
    line = (F.col("page_no") - 1) * 8 + F.col("ordinal")
    m = F.col("artifact_id") * 3 + line
    length = F.char_length("content")
    kind = F.expr(
        "CASE (artifact_id + (page_no - 1) * 8 + ordinal) % 4 WHEN 0 THEN 'text'"
        " WHEN 1 THEN 'factual' WHEN 2 THEN 'citation' ELSE 'implementation' END"
    )
    said = F.col("content")

    def fault(n: int):
        return F.lit(faulty) & (m % n == 0)

    return batched.select(
        "artifact_id",
        "group_rank",
        "batch_no",
        "position",
        F.struct(
            F.when(fault(151), "opinion").otherwise(kind).alias("claim_type"),
            F.when(fault(154), "  ").otherwise(said).alias("text_content"),
            F.col("external_id").alias("source_block_external_id"),
            F.array(F.when(fault(153), "p0-b0").otherwise(F.col("external_id"))).alias(
                "context_block_external_ids"
            ),
            F.when(fault(152), F.array(F.lit("[999]")))
            .otherwise(F.col("markers"))
            .alias("citation_markers"),
            F.struct(
                F.lit(0).alias("start"),
                F.when(fault(150), length + 1).otherwise(length).alias("end"),
            ).alias("source_span"),
        ).alias("claim"),
    )


def claim_responses(claims: DataFrame, cut_short: bool) -> DataFrame:
    """The claims of each batch as a model response; a batch is bounded by its packing limit."""
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("position", "claim"))), lambda c: c["claim"]
    )
    finish = F.when(F.lit(cut_short) & (F.col("artifact_id") % 40 == 0), "length").otherwise("stop")
    content = F.to_json(F.struct(F.col("claims")))
    choice = F.struct(
        finish.alias("finish_reason"), F.struct(content.alias("content")).alias("message")
    )
    return (
        claims.groupBy("artifact_id", "group_rank", "batch_no")
        .agg(listed.alias("claims"))
        .select(
            "artifact_id",
            "group_rank",
            "batch_no",
            F.to_json(F.struct(F.array(choice).alias("choices"))).alias("response"),
        )
    )


def artifacts(spark: SparkSession, directory: str) -> DataFrame:
    items = spread(table(spark, directory, "lineitem")).select(
        F.expr(
            "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber,"
            " CAST(l_quantity AS BIGINT))"
        ).alias("artifact_id"),
        F.col("l_orderkey").alias("submission_id"),
        F.expr("CASE WHEN l_suppkey % 2 = 0 THEN 'report_pdf' ELSE 'source_archive' END").alias(
            "kind"
        ),
        F.col("l_linenumber").alias("version_no"),
        (F.col("l_quantity").cast("bigint") * 1000).alias("byte_size"),
        "l_partkey",
    )
    uri = F.expr(
        "concat(CASE WHEN l_partkey % 11 = 0 THEN 'http' ELSE 'cloudinary' END,"
        " '://raw/authenticated/corpus/submissions/', submission_id, '/', kind, '/',"
        " CASE WHEN l_partkey % 11 = 2 THEN '../' ELSE '' END, l_partkey,"
        " CASE WHEN l_partkey % 11 = 1 THEN '?x=1' ELSE '' END)"
    )
    return items.withColumn("object_uri", uri).withColumn("sha256", F.sha2("artifact_id", 256))


def measured(spark: SparkSession, directory: str) -> DataFrame:
    """What a download of each artifact would have measured, some of it changed."""
    return artifacts(spark, directory).select(
        "artifact_id",
        F.expr("byte_size + IF(l_partkey % 13 = 0, 1, 0)").alias("measured_size"),
        F.expr("IF(l_partkey % 17 = 0, sha2('x', 256), sha256)").alias("measured_sha256"),
        F.expr(
            "CASE l_partkey % 7 WHEN 0 THEN 'PK' WHEN 1 THEN '\\n  %PDF-1.7' ELSE '%PDF-1.4' END"
        )
        .cast("binary")
        .alias("head"),
    )


def submissions(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "orders").select(
        F.col("o_orderkey").alias("submission_id"),
        F.col("o_custkey").alias("project_id"),
        F.col("o_custkey").alias("group_id"),
        F.expr("o_orderkey % 7").alias("submitted_by_user_id"),
        F.expr("o_custkey + IF(o_orderkey % 23 = 0, 1, 0)").alias("rubric_version_id"),
        F.expr("1 + o_orderkey % 3").alias("attempt_no"),
        F.expr("IF(o_orderkey % 4 = 0, concat('k', o_custkey), NULL)").alias("idempotency_key"),
        F.expr(
            "CASE o_orderstatus WHEN 'O' THEN 'uploaded' WHEN 'P' THEN 'processing'"
            " ELSE 'completed' END"
        ).alias("status"),
        F.col("o_orderdate").alias("received_at"),
    )


def requests_and_stored(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Submissions received before May 1998 as stored, the later ones as requests."""
    every = submissions(spark, directory)
    stored = F.col("received_at") < F.lit("1998-05-01").cast("timestamp")
    return every.filter(~stored).withColumnRenamed("submission_id", "request_id"), every.filter(
        stored
    )


def projects(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "customer").select(
        F.col("c_custkey").alias("project_id"),
        F.expr(
            "CASE c_mktsegment WHEN 'FURNITURE' THEN 'closed' WHEN 'AUTOMOBILE' THEN 'draft'"
            " ELSE 'open' END"
        ).alias("status"),
    )


def rubrics(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "customer").select(
        F.col("c_custkey").alias("rubric_version_id"),
        F.col("c_custkey").alias("project_id"),
        F.expr("IF(c_custkey % 5 = 0, 'draft', 'published')").alias("status"),
    )


def members(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "customer").select(
        F.col("c_custkey").alias("group_id"),
        F.col("c_custkey").alias("project_id"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("user_id"),
    )


def raw_nodes(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "part").select(
        F.expr("p_partkey % 50").alias("graph_id"),
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("label"),
        F.expr("IF(p_partkey % 31 = 0, NULL, concat('src/', p_brand, '.py'))").alias(
            "source_file"
        ),
        F.expr("concat('L', p_size)").alias("source_location"),
        F.expr(
            "CASE p_type WHEN 'STANDARD' THEN 'AMBIGUOUS' WHEN 'PROMO' THEN 'INFERRED'"
            " ELSE 'EXTRACTED' END"
        ).alias("confidence"),
        F.lit(None).cast("double").alias("confidence_score"),
        F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("string").alias("metadata_kind"),
        F.lit(None).cast("string").alias("metadata_type"),
        F.expr("p_size > 45").alias("callable_class"),
        F.expr("p_size > 25").alias("callable"),
    )


def raw_edges(spark: SparkSession, directory: str) -> DataFrame:
    """Calls between parts. Evidence follows from an edge's identity, except in every tenth
    graph, where equal identities may disagree."""
    parts = table(spark, directory, "part").select("p_partkey", "p_brand")
    items = spread(table(spark, directory, "lineitem")).join(
        parts, F.col("l_partkey") == F.col("p_partkey")
    )
    return items.select(
        F.expr("l_partkey % 50").alias("graph_id"),
        F.col("l_partkey").cast("string").alias("source"),
        F.expr("CAST(l_partkey + 50 * (l_suppkey % 5) AS STRING)").alias("target"),
        F.expr(
            "CASE l_linenumber WHEN 1 THEN 'method' WHEN 2 THEN 'imports_from' WHEN 3 THEN 'calls'"
            " ELSE 'references' END"
        ).alias("relation"),
        F.expr("IF(l_partkey % 31 = 0, NULL, concat('src/', p_brand, '.py'))").alias(
            "source_file"
        ),
        F.expr(
            "concat('L', l_linenumber, '-L', CAST(l_linenumber + l_quantity AS BIGINT))"
        ).alias("source_location"),
        F.expr(
            "CASE WHEN l_partkey % 50 % 10 = 0 THEN"
            " CASE l_returnflag WHEN 'A' THEN 'EXTRACTED' WHEN 'N' THEN 'INFERRED'"
            " ELSE 'AMBIGUOUS' END"
            " ELSE CASE (l_partkey + l_linenumber) % 3 WHEN 0 THEN 'EXTRACTED'"
            " WHEN 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END END"
        ).alias("confidence"),
        F.expr(
            "CASE WHEN (l_partkey + l_linenumber) % 4 = 0 THEN NULL"
            " ELSE CAST((l_partkey + 2 * l_linenumber) % 11 AS DOUBLE) / 10 END"
        ).alias("confidence_score"),
    )


def inventory(spark: SparkSession, directory: str) -> DataFrame:
    nodes = raw_nodes(spark, directory).filter("source_file IS NOT NULL")
    return (
        nodes.select("graph_id", F.col("source_file").alias("path"))
        .distinct()
        .withColumn("line_count", F.expr("IF(graph_id % 10 = 1, 40, 60)"))
    )


def archive_members(spark: SparkSession, directory: str) -> DataFrame:
    items = spread(table(spark, directory, "lineitem")).select(
        F.col("l_orderkey").alias("archive_id"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.floor("l_extendedprice").cast("bigint").alias("file_size"),
    )
    numbered = position_in_unit(
        items, ["archive_id"], ["l_linenumber", "l_partkey", "l_suppkey", "file_size"], "entry_no"
    )
    plain = F.expr("concat('src/m', l_partkey % 50, '.py')")
    return numbered.select(
        "archive_id",
        "entry_no",
        F.when(F.expr("l_partkey % 97 = 0"), "../x.py")
        .when(F.expr("l_partkey % 89 = 0"), "a/CON.txt")
        .when(F.expr("l_partkey % 83 = 0"), "a//b.py")
        .when(F.expr("l_suppkey % 4 = 0"), F.upper(plain))
        .otherwise(plain)
        .alias("name"),
        "file_size",
        F.expr(
            "CASE WHEN l_partkey % 103 = 0 THEN file_size DIV 200"
            " ELSE file_size DIV (l_partkey % 20 + 1) END"
        ).alias("compress_size"),
        F.expr("IF(l_partkey % 101 = 0, 'symlink', 'regular')").alias("mode"),
    )


ARCHIVE_LIMITS = {
    "max_entries": 9,
    "max_total": 250_000,
    "max_file": 100_000,
    "max_depth": 5,
    "max_ratio": 100,
}


def source_files(spark: SparkSession, directory: str) -> DataFrame:
    name = F.expr(
        "CASE doc_id % 10 WHEN 0 THEN 'f.py' WHEN 1 THEN 'App.TSX' WHEN 2 THEN 'node_modules/x.js'"
        " WHEN 3 THEN 'package.json' WHEN 4 THEN 'run' WHEN 5 THEN 'x.min.js'"
        " WHEN 6 THEN '.env.local' WHEN 7 THEN 'readme.md' WHEN 8 THEN 'build'"
        " ELSE 'Main.java' END"
    )
    content = F.when(
        F.expr("doc_id % 10 = 4"), F.concat(F.lit("#!/usr/bin/env python\n"), "text")
    ).otherwise(F.col("text"))
    return spread(table(spark, directory, "documents")).select(
        F.col("source").alias("archive_id"),
        F.concat(F.lit("p"), F.col("doc_id"), F.lit("/"), name).alias("path"),
        content.cast("binary").alias("content"),
    )


FILE_LIMIT = 20_000


def intake_rows(events: DataFrame) -> DataFrame:
    """Requests with a key that repeats per user, or none; of the events table or its stream."""
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("received_at"),
        F.expr(
            "IF(event_id % 3 = 0, NULL, concat('k', user_id, '-', event_id % 40))"
        ).alias("idempotency_key"),
    )


def arrival_rows(events: DataFrame) -> DataFrame:
    """Artifacts as they arrive; of the events table or its stream."""
    return events.select(
        F.col("user_id").alias("submission_id"),
        F.expr(
            "IF(event_type IN ('click', 'view'), 'report_pdf', 'source_archive')"
        ).alias("kind"),
        F.col("event_id").alias("version_no"),
        F.col("ts").alias("registered_at"),
    )


def runs(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("submission_id"),
        F.col("ts").alias("started_at"),
        F.expr("IF(event_type = 'error', 'failed', 'succeeded')").alias("status"),
    )
