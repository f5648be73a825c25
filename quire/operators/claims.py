"""Claims: candidate text, bounded batches, requests, responses and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import ids, text
from quire.operators.layout import PAGES_PER_SEGMENT, page_segments
from quire.operators.scan import SEGMENT, Running, segmented_scan
from quire.rejects import Code, drop_units, first_failure, reject_rows
from quire.session import materialize

# Claim types, prompt version, limits.
CLAIM_TYPES = ("text", "factual", "citation", "implementation")
PROMPT_VERSION = "claims-1"
MAX_BATCH_CHARS = 24_000
MAX_RESPONSE_BYTES = 32 * 1024 * 1024

#: Blocks of a segment: each is tried as the first one that opens a batch there.
SEGMENT_BLOCKS = 64

RESPONSE = "choices ARRAY<STRUCT<finish_reason: STRING, message: STRUCT<content: STRING>>>"
CLAIM_ARRAY = (
    "ARRAY<STRUCT<claim_type: STRING, text_content: STRING, source_block_external_id: STRING, "
    "context_block_external_ids: ARRAY<STRING>, citation_markers: ARRAY<STRING>, "
    "source_span: STRING, is_atomic: BOOLEAN, confidence: DOUBLE>>"
)


def claim_candidates(blocks: DataFrame) -> DataFrame:
    """Text blocks with text that are not titles, captions, page furniture or references."""
    return blocks.filter(
        (F.col("block_type") == "text") & (F.col("content") != "") & ~F.col("exclude_from_claims")
    )


def group_section_text(candidates: DataFrame, pages: int = PAGES_PER_SEGMENT) -> DataFrame:
    """``group_rank`` and ``position`` of each candidate: its section's rank in the document by
    first appearance, and its place in the section. Blocks before any section form a group.

    One row per block, ordered by columns; a section is not gathered into an array.
    """
    keyed = candidates.withColumn("_section", F.coalesce("section_ordinal", F.lit(-1)))
    groups = materialize(
        keyed.groupBy("artifact_id", "_section")
        .agg(F.min(F.struct("page_no", "reading_order")).alias("_first"))
        .withColumn(SEGMENT, F.floor(F.col("_first.page_no") / pages).cast("int"))
    )
    ranked = segmented_scan(
        groups, ["artifact_id"], ["_first"], [Running("_rank", F.lit(1))]
    ).select("artifact_id", "_section", (F.col("_rank") - 1).cast("int").alias("group_rank"))
    placed = segmented_scan(
        page_segments(keyed, pages),
        ["artifact_id", "_section"],
        ["page_no", "reading_order"],
        [Running("_position", F.lit(1))],
    )
    return (
        placed.join(ranked, ["artifact_id", "_section"])
        .withColumn("position", (F.col("_position") - 1).cast("int"))
        .drop("_section", "_position", SEGMENT)
    )


def batch_section_text(
    grouped: DataFrame,
    max_chars: int = MAX_BATCH_CHARS,
    segment_blocks: int = SEGMENT_BLOCKS,
    length: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``batch_no`` of each block in its section: greedy packing up to ``max_chars`` characters.

    A single block over the limit voids the artifact. Sections that fit in one batch need no
    packing; of all others, of any number of blocks, segments are packed side by side (see
    ``_packed``). Text is not moved: only ids and lengths are, and the batch number joins back.
    ``length`` is the character count, that of ``content`` unless given.
    """
    length = F.char_length("content") if length is None else length
    too_long = (
        grouped.filter(length > max_chars)
        .groupBy("artifact_id")
        .agg(F.min(F.struct("group_rank", "position", "external_id")).alias("at"))
    )
    rejects = reject_rows(
        too_long,
        "artifact_id",
        Code.PARSER_ERROR,
        "text block exceeds claim extraction quota",
        F.col("at.external_id"),
    )
    rejects = materialize(rejects)  # found once, and known to be few when units are dropped
    accepted = drop_units(grouped, rejects, "artifact_id")
    slim = materialize(accepted.select("artifact_id", "group_rank", "position", length.cast("long").alias("n")))
    group = ["artifact_id", "group_rank"]
    sizes = slim.groupBy(*group).agg(F.sum("n").alias("_chars")).filter(F.col("_chars") > max_chars)
    packed = _packed(slim.join(sizes.select(*group), group, "left_semi"), max_chars, segment_blocks)
    batched = accepted.join(packed, [*group, "position"], "left").withColumn(
        "batch_no", F.coalesce("batch_no", F.lit(0))
    )
    return batched, rejects


def _packed(slim: DataFrame, max_chars: int, segment_blocks: int) -> DataFrame:
    """Batch numbers of sections of any size, by transfer functions of their segments.

    What the blocks before a segment leave it is one number, the characters of the open batch. The
    larger it is, the earlier the first block that opens a batch; from there on all is settled within the
    segment. So a segment is a short list of pieces, (entry above which this block opens first, batches
    opened, characters left open), and a section's segments are followed through their pieces, one step
    each. Then every segment packs its own blocks from its entry.
    """
    unit = ["artifact_id", "group_rank"]
    long0 = F.lit(0).cast("long")
    segments = slim.groupBy(*unit, F.floor(F.col("position") / segment_blocks).cast("int").alias(SEGMENT)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "n"))), lambda b: b["n"]).alias("_n")
    )

    def state(size: Column, batch: Column) -> Column:
        return F.struct(size.cast("long").alias("size"), batch.cast("int").alias("batch"))

    def step(s: Column, n: Column) -> Column:
        opens = (s["size"] > 0) & (s["size"] + n > max_chars)
        return state(F.when(opens, n).otherwise(s["size"] + n), s["batch"] + opens.cast("int"))

    def total(x: Column) -> Column:
        return F.aggregate(x, long0, lambda a, b: a + b)

    def piece(n: Column, i: Column) -> Column:
        left = F.aggregate(F.slice("_n", i + 2, F.size("_n")), state(n, F.lit(1)), step)
        return F.struct((max_chars - total(F.slice("_n", F.lit(1), i + 1))).alias("above"), left.alias("left"))

    functions = segments.select(*unit, SEGMENT, F.transform("_n", piece).alias("pieces"), total(F.col("_n")).alias("all"))
    each = F.struct(SEGMENT, "pieces", "all")
    listed = functions.groupBy(*unit).agg(F.array_sort(F.collect_list(each)).alias("_all")).where(F.size("_all") > 1)
    entries = "array<struct<segment:int,entry:struct<size:bigint,batch:int>>>"

    def follow(s: Column, x: Column) -> Column:
        size, batch = s["at"]["size"], s["at"]["batch"]
        first = F.get(F.filter(x["pieces"], lambda p: size > p["above"]), F.lit(0))
        after = F.when(first.isNull(), state(size + x["all"], batch)).otherwise(
            state(first["left"]["size"], batch + first["left"]["batch"])
        )
        entry = F.struct(x[SEGMENT].alias("segment"), s["at"].alias("entry"))
        return F.struct(after.alias("at"), F.concat(s["out"], F.array(entry)).alias("out"))

    start = F.struct(state(long0, F.lit(0)).alias("at"), F.array().cast(entries).alias("out"))
    known = listed.select(*unit, F.explode(F.aggregate("_all", start, follow, lambda s: s["out"])).alias("_e")).select(
        *unit, F.col("_e.segment").alias(SEGMENT), F.col("_e.entry").alias("_entry")
    )

    def number(s: Column, n: Column) -> Column:
        after = step(s["at"], n)
        return F.struct(after.alias("at"), F.concat(s["out"], F.array(after["batch"])).alias("out"))

    entry = F.coalesce("_entry", state(long0, F.lit(0)))
    begin = F.struct(entry.alias("at"), F.array().cast("array<int>").alias("out"))
    numbered = segments.join(known, [*unit, SEGMENT], "left").withColumn(
        "_out", F.aggregate("_n", begin, number, lambda s: s["out"])
    )
    return numbered.select(*unit, SEGMENT, F.posexplode("_out").alias("_at", "batch_no")).select(
        *unit, (F.col(SEGMENT) * segment_blocks + F.col("_at")).cast("int").alias("position"), "batch_no"
    )


def build_claim_requests(batched: DataFrame, sections: DataFrame) -> DataFrame:
    """One JSON payload per batch. A batch holds at most the packing limit of characters."""
    block = F.struct(
        "position",
        F.struct(
            F.col("external_id"),
            F.col("content").alias("text_content"),
            F.col("markers").alias("citation_marker_ids"),
        ).alias("block"),
    )
    batches = batched.groupBy("artifact_id", "section_ordinal", "group_rank", "batch_no").agg(
        F.transform(F.array_sort(F.collect_list(block)), lambda b: b["block"]).alias("blocks"),
        F.count("*").alias("n_blocks"),
        F.sum(F.char_length("content")).alias("n_chars"),
    )
    titles = sections.select(
        "artifact_id", F.col("ordinal").alias("section_ordinal"), F.col("title")
    )
    payload = F.to_json(
        F.struct(F.col("title").alias("section_title"), "blocks"), {"ignoreNullFields": "false"}
    )
    return batches.join(titles, ["artifact_id", "section_ordinal"], "left").select(
        "artifact_id",
        "section_ordinal",
        "group_rank",
        "batch_no",
        "n_blocks",
        "n_chars",
        payload.alias("payload"),
    )


def parse_claim_responses(
    responses: DataFrame,
    batched: DataFrame,
    model: str,
    max_bytes: int = MAX_RESPONSE_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Claims of every response, checked against the batch they answer.

    ``responses`` has ``(artifact_id, group_rank, batch_no, response)``. A response that did not
    stop normally, holds no JSON list of claims or points outside its batch voids the artifact,
    and so does a batch that was never answered. Responses are parsed once into a table.
    """
    batch = ["artifact_id", "group_rank", "batch_no"]
    size = F.octet_length("response")
    answer = F.from_json(F.when(size <= max_bytes, F.col("response")), RESPONSE)
    unpacked = responses.select(*batch, size.alias("size"), answer.alias("answer")).select(
        *batch, "size", F.get("answer.choices", F.lit(0)).alias("choice")
    )
    said = F.from_json("choice.message.content", f"claims {CLAIM_ARRAY}")
    fault = first_failure(
        (F.col("size") > max_bytes, "response exceeds quota"),
        (
            ~F.coalesce(F.col("choice.finish_reason") == "stop", F.lit(False)),
            "incomplete output",
        ),
        (
            F.col("said.claims").isNull()
            & F.try_parse_json("choice.message.content").isNull(),
            "content is not JSON",
        ),
        (F.col("said.claims").isNull(), "expected claims array"),
    )
    read = materialize(
        unpacked.withColumn("said", said).select(
            *batch, fault.alias("fault"), F.col("said.claims").alias("claims")
        )
    )
    broken = read.filter(F.col("fault").isNotNull()).select(
        "artifact_id", "group_rank", "batch_no", "fault"
    )
    parsed = read.filter(F.col("fault").isNull()).select(
        "artifact_id", "group_rank", "batch_no", F.posexplode("claims").alias("claim_no", "claim")
    )
    parsed = parsed.select(
        "artifact_id", "group_rank", "batch_no", "claim_no", "claim.*"
    ).withColumn("source_span", _span(F.col("source_span")))

    named = F.array_distinct(
        F.concat(
            F.array("source_block_external_id"),
            F.coalesce("context_block_external_ids", F.array().cast("array<string>")),
        )
    )
    references = parsed.select(*batch, F.explode(named).alias("external_id")).distinct()
    outside = references.join(
        batched.select(*batch, "external_id"), [*batch, "external_id"], "left_anti"
    ).select(*batch, F.lit("claim references text outside its input").alias("fault"))
    asked = batched.select(*batch).distinct()
    unanswered = asked.join(responses.select(*batch), batch, "left_anti").select(
        *batch, F.lit("no response").alias("fault")
    )
    first = (
        broken.unionByName(outside)
        .unionByName(unanswered)
        .groupBy("artifact_id")
        .agg(F.min(F.struct("group_rank", "batch_no", "fault")).alias("at"))
    )
    rejects = reject_rows(
        first,
        "artifact_id",
        Code.PARSER_ERROR,
        F.col("at.fault"),
        F.format_string("%d/%d", "at.group_rank", "at.batch_no"),
    )
    rejects = materialize(rejects)
    stamped = parsed.withColumn(
        "extractor_version", F.lit(f"{model}:{PROMPT_VERSION}")
    ).withColumn(
        "external_id",
        ids.claim_id(
            F.col("source_block_external_id"),
            F.col("source_span.start"),
            F.col("source_span.end"),
            F.col("text_content"),
            F.col("claim_type"),
        ),
    )
    return drop_units(stamped, rejects, "artifact_id"), rejects


def _span(said: Column) -> Column:
    """A source span; without ends where it holds any other key, so that it cannot be valid."""
    known = F.array(F.lit("start"), F.lit("end"))
    only = F.size(F.array_except(F.json_object_keys(said), known)) == 0
    read = F.from_json(said, "start INT, end INT")
    nothing = F.from_json(F.lit("{}"), "start INT, end INT")
    return F.when(said.isNotNull(), F.when(F.coalesce(only, F.lit(False)), read).otherwise(nothing))


def citation_subset_audit(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """Claims with a citation marker found neither in their source block nor in a context block.

    Only distinct (block, marker) pairs are joined; a marker counts as found in any named block.
    """
    markers = blocks.select(
        "artifact_id",
        F.col("external_id").alias("_block"),
        F.explode("markers").alias("_marker"),
    )
    key = ["artifact_id", "external_id", "group_rank", "batch_no", "claim_no"]
    wanted = claims.select(
        *key,
        F.explode(F.array_distinct("citation_markers")).alias("_marker"),
        F.array_distinct(
            F.concat(F.array("source_block_external_id"), "context_block_external_ids")
        ).alias("_named"),
    )
    found = (
        wanted.withColumn("_block", F.explode("_named"))
        .join(markers, ["artifact_id", "_block", "_marker"], "left_semi")
        .select(*key, "_marker")
    )
    return (
        wanted.join(found, [*key, "_marker"], "left_anti")
        .groupBy(*key)
        .agg(F.array_join(F.sort_array(F.collect_set("_marker")), ",").alias("invented"))
    )


def validate_claims(
    claims: DataFrame, grouped: DataFrame, length: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Keep the claims of artifacts in which every claim passes every check.

    ``claims`` comes from ``parse_claim_responses``; ``grouped`` from ``group_section_text``. What a claim's text
    decides is settled before claims move, so texts stay; ``length`` is as in ``batch_section_text``.
    The reported failure is the first in reading order: per section first the schema of all its
    claims, then claim by claim duplicate id or foreign source, context outside the section,
    span, citations.
    """
    no_texts = F.array().cast("array<string>")
    claims = claims.withColumns(
        {
            "context_block_external_ids": F.coalesce("context_block_external_ids", no_texts),
            "citation_markers": F.coalesce("citation_markers", no_texts),
            "is_atomic": F.coalesce("is_atomic", F.lit(False)),
        }
    )
    key = ["artifact_id", "group_rank", "batch_no", "claim_no"]
    # Each named block meets its facts once; a claim then gathers what its few blocks told.
    named = F.array_distinct(F.concat(F.array("source_block_external_id"), "context_block_external_ids"))
    references = claims.select(
        *key, "source_block_external_id", "context_block_external_ids", F.explode(named).alias("_block")
    ).select(
        *key,
        "_block",
        (F.col("_block") == F.col("source_block_external_id")).alias("_is_source"),
        F.array_contains("context_block_external_ids", F.col("_block")).alias("_is_context"),
    )
    facts = grouped.select(
        "artifact_id",
        F.col("external_id").alias("_block"),
        F.col("group_rank").alias("_group"),
        (F.char_length("content") if length is None else length).alias("_chars"),
        F.col("markers").alias("_markers"),
    )
    inside = F.coalesce(F.col("_group") == F.col("group_rank"), F.lit(False))
    told = (
        references.join(facts, ["artifact_id", "_block"], "left")
        .groupBy(*key)
        .agg(
            F.max(F.when(F.col("_is_source") & inside, F.col("_chars"))).alias("_source_chars"),
            F.max(F.col("_is_context") & ~inside).alias("_foreign"),
            F.flatten(F.collect_list("_markers")).alias("_found"),
        )
    )
    span = F.col("source_span")
    schema = first_failure(
        (~F.coalesce(F.col("claim_type").isin(*CLAIM_TYPES), F.lit(False)), "claim type"),
        (
            F.col("text_content").isNull()
            | F.col("source_block_external_id").isNull()
            | span.isNull()
            | F.exists("context_block_external_ids", lambda c: c.isNull())
            | F.exists("citation_markers", lambda c: c.isNull()),
            "missing field",
        ),
        (~F.coalesce(F.col("confidence").between(0, 1), F.lit(True)), "confidence range"),
        (F.coalesce(F.col("extractor_version"), F.lit("")) == "", "extractor version"),
    )
    good = (span["start"] >= 0) & (span["start"] < span["end"]) & ~text.is_blank(F.col("text_content"))
    slim = claims.select(
        *key,
        "external_id",
        schema.alias("_schema"),
        F.when(F.coalesce(good, F.lit(False)), span["end"]).alias("_end"),
        F.when(F.size("citation_markers") > 0, F.col("citation_markers")).alias("_cited"),
    )
    same = Window.partitionBy("artifact_id", "external_id").orderBy("group_rank", "batch_no", "claim_no")
    joined = slim.withColumn("_nth", F.row_number().over(same)).join(told, key, "left")
    invented = F.size(F.array_except("_cited", "_found")) > 0
    rules = first_failure(
        (F.col("_nth") > 1, "duplicate claim"),
        (F.col("_source_chars").isNull(), "source outside section"),
        (F.coalesce(F.col("_foreign"), F.lit(False)), "context outside section"),
        (~F.coalesce(F.col("_end") <= F.col("_source_chars"), F.lit(False)), "invalid source span"),
        (F.coalesce(invented, F.lit(False)), "invented citation markers"),
    )
    failing = joined.select(
        "artifact_id",
        F.struct(
            "group_rank",
            F.when(F.col("_schema").isNotNull(), 0).otherwise(1).alias("phase"),
            "batch_no",
            "claim_no",
        ).alias("at"),
        F.coalesce("_schema", rules).alias("message"),
        "external_id",
    ).filter(F.col("message").isNotNull())
    first = failing.groupBy("artifact_id").agg(
        F.min(F.struct("at", "message", "external_id")).alias("f")
    )
    rejects = reject_rows(
        first, "artifact_id", Code.PARSER_ERROR, F.col("f.message"), F.col("f.external_id")
    )
    rejects = materialize(rejects)
    return drop_units(claims, rejects, "artifact_id"), rejects


def resolve_claim_references(
    claims: DataFrame, blocks: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Source block id and the ordered context ids as table ids; an unknown one voids the unit.

    Table ids are hashes of natural keys, so order is kept by mapping the array in place and
    only the distinct references are looked up.
    """
    named = F.concat(F.array("source_block_external_id"), "context_block_external_ids")
    wanted = claims.select("artifact_id", F.explode(named).alias("external_id")).distinct()
    lost = (
        wanted.join(blocks.select("artifact_id", "external_id"), ["artifact_id", "external_id"],
                    "left_anti")
        .groupBy("artifact_id")
        .agg(F.min("external_id").alias("offender"))
    )
    rejects = reject_rows(
        lost, "artifact_id", Code.INTERNAL_ERROR, "unknown block reference", F.col("offender")
    )
    rejects = materialize(rejects)
    unit = F.col("artifact_id")
    resolved = drop_units(claims, rejects, "artifact_id").withColumns(
        {
            "id": ids.table_id(unit, F.col("external_id")),
            "source_block_id": ids.table_id(unit, F.col("source_block_external_id")),
            "context_block_ids": F.transform(
                "context_block_external_ids", lambda c: ids.table_id(unit, c)
            ),
        }
    )
    return resolved, rejects


def claims_per_submission(claims: DataFrame, unit: str = "submission_id") -> DataFrame:
    return claims.groupBy(unit).agg(F.count(F.lit(1)).alias("n_claims"))
