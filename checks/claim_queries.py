"""Queries over claims: grouping, packing, requests, responses, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import register
from quire.functions import ids
from quire.operators import claims as C
from quire.operators import layout as L
from quire.plans import claims as plan
from quire.session import materialize, scratch_folder
from quire.sources.sinks import claim_rows
from quire.sources.store import Part, Store

LIMIT = I.CLAIM_BATCH_CHARS


def _answers(spark, d, faulty: bool, cut_short: bool):
    batched = materialize(I.batched_candidates(spark, d, LIMIT))
    responses = I.claim_responses(I.claim_rows(batched, faulty), cut_short)
    return batched, responses


@register("SELECT artifact_id, page_no, reading_order, external_id FROM candidates")
def claim_candidates(spark, d):
    return C.claim_candidates(I.parsed_blocks(spark, d)).select(
        "artifact_id", "page_no", "reading_order", "external_id"
    )


@register("SELECT artifact_id, section_ordinal, group_rank, position, external_id FROM grouped")
def group_section_text(spark, d):
    return I.candidates(spark, d).select(
        "artifact_id", "section_ordinal", "group_rank", "position", "external_id"
    )


@register("SELECT artifact_id, group_rank, position, batch_no::BIGINT AS batch_no FROM batched")
def batch_section_text(spark, d):
    return I.batched_candidates(spark, d, LIMIT).select(
        "artifact_id", "group_rank", "position", "batch_no"
    )


@register("""
    SELECT artifact_id::VARCHAR AS unit_id, 'parser_error' AS code,
           'text block exceeds claim extraction quota' AS message,
           arg_min(external_id, group_rank * 1000000 + position) AS offender
    FROM grouped WHERE len(content) > 24000 GROUP BY artifact_id""")
def batch_section_rejects(spark, d):
    return C.batch_section_text(I.candidates(spark, d), LIMIT)[1]


@register("""
    SELECT b.artifact_id, b.group_rank, b.batch_no::BIGINT AS batch_no, count(*) AS n_blocks,
           sum(len(b.content))::BIGINT AS n_chars, any_value(s.title) AS section_title,
           string_agg(b.content, chr(10) ORDER BY b.position) AS texts,
           string_agg(b.external_id, ',' ORDER BY b.position) AS block_ids
    FROM batched b LEFT JOIN sections s
      ON s.artifact_id = b.artifact_id AND s.ordinal = b.section_ordinal
    GROUP BY b.artifact_id, b.group_rank, b.batch_no""")
def build_claim_requests(spark, d):
    blocks = materialize(I.batched_candidates(spark, d, LIMIT))
    sections = L.detect_sections(I.layout_blocks(spark, d))
    requests = C.build_claim_requests(blocks, sections)
    shape = (
        "section_title STRING, blocks ARRAY<STRUCT<external_id: STRING, text_content: STRING,"
        " citation_marker_ids: ARRAY<STRING>>>"
    )
    read = requests.withColumn("p", F.from_json("payload", shape))
    return read.select(
        "artifact_id",
        "group_rank",
        "batch_no",
        "n_blocks",
        "n_chars",
        F.col("p.section_title").alias("section_title"),
        F.array_join("p.blocks.text_content", "\n").alias("texts"),
        F.array_join("p.blocks.external_id", ",").alias("block_ids"),
    )


@register("""
    SELECT artifact_id, group_rank, batch_no::BIGINT AS batch_no, claim_id AS external_id,
           claim_type, claim_text AS text_content, external_id AS source_block_external_id,
           span_end::BIGINT AS span_end, 'model-a:claims-1' AS extractor_version,
           array_to_string(markers, '|') AS citation_markers
    FROM claims_with_ids WHERE artifact_id % 40 <> 0""")
def parse_claim_responses(spark, d):
    batched, responses = _answers(spark, d, False, True)
    return C.parse_claim_responses(responses, batched, I.MODEL)[0].select(
        "artifact_id",
        "group_rank",
        "batch_no",
        "external_id",
        "claim_type",
        "text_content",
        "source_block_external_id",
        F.col("source_span.end").alias("span_end"),
        "extractor_version",
        F.array_join("citation_markers", "|").alias("citation_markers"),
    )


@register("""
    SELECT artifact_id::VARCHAR AS unit_id, 'parser_error' AS code,
           CASE WHEN artifact_id % 40 = 0 THEN 'incomplete output'
                ELSE 'claim references text outside its input' END AS message,
           arg_min(group_rank || '/' || batch_no, group_rank * 1000000 + batch_no) AS offender
    FROM claims_said
    WHERE artifact_id % 40 = 0 OR (artifact_id * 3 + i) % 153 = 0 GROUP BY artifact_id""")
def parse_claim_rejects(spark, d):
    batched, responses = _answers(spark, d, True, True)
    return C.parse_claim_responses(responses, batched, I.MODEL)[1]


FAULTS = """
    SELECT artifact_id, group_rank, batch_no, position, m,
           CASE WHEN m % 151 = 0 THEN 'claim type'
                WHEN m % 153 = 0 THEN 'context outside section'
                WHEN m % 150 = 0 OR m % 154 = 0 THEN 'invalid source span'
                WHEN m % 152 = 0 THEN 'invented citation markers' END AS message,
           CASE WHEN m % 151 = 0 THEN 0 ELSE 1 END AS phase
    FROM (SELECT *, artifact_id * 3 + i AS m FROM claims_said)"""


@register(f"""
    SELECT artifact_id::VARCHAR AS unit_id, 'parser_error' AS code,
           arg_min(message, (group_rank * 10 + phase) * 1000000 + batch_no * 1000 + position)
             AS message
    FROM ({FAULTS}) WHERE message IS NOT NULL GROUP BY artifact_id""")
def validate_claims(spark, d):
    batched = materialize(I.batched_candidates(spark, d, LIMIT))
    return C.validate_claims(_claims_of(batched, faulty=True), batched)[1].drop("offender")


def _claims_of(batched, faulty: bool):
    """Claims as a parsed response would give them, without the response text."""
    rows = I.claim_rows(batched, faulty).select(
        "artifact_id", "group_rank", "batch_no", F.col("position").alias("claim_no"), "claim.*"
    )
    return rows.withColumns(
        {
            "is_atomic": F.lit(False),
            "confidence": F.lit(None).cast("double"),
            "extractor_version": F.lit(f"{I.MODEL}:{C.PROMPT_VERSION}"),
            "external_id": ids.claim_id(
                F.col("source_block_external_id"),
                F.col("source_span.start"),
                F.col("source_span.end"),
                F.col("text_content"),
                F.col("claim_type"),
            ),
        }
    )


@register("""
    SELECT artifact_id, group_rank, batch_no::BIGINT AS batch_no, position AS claim_no,
           '[999]' AS invented
    FROM claims_said WHERE (artifact_id * 3 + i) % 152 = 0""")
def citation_subset_audit(spark, d):
    batched = materialize(I.batched_candidates(spark, d, LIMIT))
    claims = _claims_of(batched, faulty=True).withColumn(
        "context_block_external_ids", F.array("source_block_external_id")
    )
    return C.citation_subset_audit(claims, batched).drop("external_id")


@register("""
    SELECT artifact_id, claim_id AS external_id,
           sha256(artifact_id || '|' || external_id) AS source_block_id,
           sha256(artifact_id || '|' || external_id) AS context_block_ids
    FROM claims_with_ids""")
def resolve_claim_references(spark, d):
    batched = materialize(I.batched_candidates(spark, d, LIMIT))
    resolved, _ = C.resolve_claim_references(_claims_of(batched, faulty=False), batched)
    return resolved.select(
        "artifact_id",
        "external_id",
        "source_block_id",
        F.array_join("context_block_ids", ",").alias("context_block_ids"),
    )


@register("""
    SELECT artifact_id::VARCHAR AS unit_id, 'internal_error' AS code,
           'unknown block reference' AS message, 'p0-b0' AS offender
    FROM claims_said WHERE (artifact_id * 3 + i) % 153 = 0 GROUP BY artifact_id""")
def resolve_claim_rejects(spark, d):
    batched = materialize(I.batched_candidates(spark, d, LIMIT))
    return C.resolve_claim_references(_claims_of(batched, faulty=True), batched)[1]


@register("""
    SELECT artifact_id::VARCHAR AS submission_id,
           sha256(artifact_id || '|' || external_id) AS source_block_id, claim_type,
           claim_text AS text_content, false AS is_atomic, false AS is_central,
           '{"citation_markers":' || to_json(markers)::VARCHAR || '}' AS qualifiers,
           span_end::BIGINT AS span_end, 1::BIGINT AS impact, 0::BIGINT AS testability,
           1::BIGINT AS risk, 'model-a:claims-1' AS extractor_version
    FROM claims_with_ids""")
def write_claim_table(spark, d):
    """Claims written as their declared table with its defaults, and read back."""
    batched = materialize(I.batched_candidates(spark, d, LIMIT))
    resolved, _ = C.resolve_claim_references(_claims_of(batched, faulty=False), batched)
    store = Store(spark, scratch_folder(spark))
    rows = claim_rows(resolved.withColumn("submission_id", F.col("artifact_id")))
    store.write([Part("claims", rows, "submission_id")])
    return store.read("claims").select(
        "submission_id",
        "source_block_id",
        "claim_type",
        "text_content",
        "is_atomic",
        "is_central",
        "qualifiers",
        F.col("source_span.end").alias("span_end"),
        "impact",
        "testability",
        "risk",
        "extractor_version",
    )


@register("""
    SELECT artifact_id AS submission_id, count(*) AS n_claims FROM claims_said
    GROUP BY artifact_id""")
def claims_per_submission(spark, d):
    claims = _claims_of(I.batched_candidates(spark, d, LIMIT), faulty=False)
    return C.claims_per_submission(claims.withColumnRenamed("artifact_id", "submission_id"))


@register("""
    SELECT artifact_id, claim_id AS external_id, claim_type,
           sha256(artifact_id || '|' || external_id) AS source_block_id
    FROM claims_with_ids
    WHERE artifact_id % 40 <> 0 AND artifact_id NOT IN
      (SELECT artifact_id FROM claims_said WHERE (artifact_id * 3 + i) % 150 = 0
          OR (artifact_id * 3 + i) % 151 = 0 OR (artifact_id * 3 + i) % 152 = 0
          OR (artifact_id * 3 + i) % 153 = 0 OR (artifact_id * 3 + i) % 154 = 0)""")
def build_claim_tables(spark, d):
    blocks = I.parsed_blocks(spark, d)
    prepared = plan.prepare_claim_batches(blocks, LIMIT)
    responses = I.claim_responses(I.claim_rows(prepared.batched, True), True)
    built = plan.build_claim_tables(blocks, responses, I.MODEL, LIMIT, prepared)
    return built.claims.select("artifact_id", "external_id", "claim_type", "source_block_id")
