"""Page-layout blocks: typing, validation, section outline, reading order, citations.

A block is one row ``(artifact_id, page_no, ordinal, label, content, x0, y0, x1, y1)``; pages
number from 1 and ``ordinal`` is the position on the page, so ``(page_no, ordinal)`` is document
order. Documents are cut into runs of pages (see ``scan``), never gathered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import ids, text
from quire.operators.nearest import SEGMENT_ROWS, nearest_smaller
from quire.operators.scan import SEGMENT, Running, segmented_scan
from quire.rejects import Code, drop_units, reject_rows

# Layout labels and what they stand for.
BLOCK_TYPE_OF_LABEL = {
    "table": "table",
    "image": "figure",
    "figure": "figure",
    "chart": "figure",
    "formula": "equation",
    "display_formula": "equation",
    "equation": "equation",
}
HEADING_LABELS = ("doc_title", "paragraph_title", "section_title")
NOT_CLAIM_LABELS = (
    "doc_title",
    "paragraph_title",
    "section_title",
    "header",
    "footer",
    "page_number",
    "figure_title",
    "table_title",
    "figure_caption",
    "table_caption",
    "reference",
    "reference_content",
)
MAX_OCR_BYTES = 32 * 1024 * 1024

PAGES_PER_SEGMENT = 256
BLOCKS_PER_SEGMENT = 4096


def literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(v) for pair in table.items() for v in pair))


def audit_layout_output(
    pages: DataFrame, max_bytes: int = MAX_OCR_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Keep the pages of artifacts within the byte quota whose every page lists block objects.

    ``pages`` has ``(artifact_id, page_no, page_json)``; an artifact without pages is one row
    with null ``page_no``, and a line that cannot be read one page without a list. With a column
    ``n_bytes``, the size of the result file, that is held against the quota, else the pages' own.
    """
    rejects = audit_pages(pages.select("artifact_id", "page_no", *page_facts(pages)), max_bytes)
    return drop_units(pages, rejects, "artifact_id"), rejects


def page_facts(pages: DataFrame) -> list[Column]:
    """What the audit of a page reads: ``n_bytes`` of its file where known, ``page_bytes``, and ``listed``."""
    blocks = F.try_parse_json(F.get_json_object("page_json", "$.parsing_res_list"))
    kind = F.schema_of_variant(blocks)
    listed = F.coalesce((kind == "ARRAY<VOID>") | kind.startswith("ARRAY<OBJECT"), F.lit(False))
    size = F.octet_length("page_json").cast("bigint").alias("page_bytes")
    return [*(F.col(c) for c in pages.columns if c == "n_bytes"), size, listed.alias("listed")]


def audit_pages(pages: DataFrame, max_bytes: int = MAX_OCR_BYTES) -> DataFrame:
    """Rejects of ``audit_layout_output`` from the ``page_facts`` of all pages."""
    size = F.max("n_bytes") if "n_bytes" in pages.columns else F.sum("page_bytes")
    unlisted = F.col("page_no").isNotNull() & ~F.col("listed")
    per_artifact = pages.groupBy("artifact_id").agg(
        F.coalesce(size, F.lit(0)).alias("n_bytes"),
        F.count("page_no").alias("n_pages"),
        F.min(F.when(unlisted, F.col("page_no"))).alias("bad_page"),
    )
    message = (
        F.when(F.col("n_bytes") > max_bytes, "output exceeds quota")
        .when(F.col("n_pages") == 0, "no pages")
        .when(F.col("bad_page").isNotNull(), "invalid page blocks")
    )
    offender = F.when(F.col("n_bytes") > max_bytes, F.col("n_bytes")).otherwise(F.col("bad_page"))
    return reject_rows(
        per_artifact.filter(message.isNotNull()),
        "artifact_id",
        Code.PARSER_ERROR,
        message,
        offender,
    )


def audit_labels(blocks: DataFrame) -> DataFrame:
    """Artifacts with a block that names no label; the first one in document order offends."""
    first = (
        blocks.filter("label IS NULL")
        .groupBy("artifact_id")
        .agg(F.min(F.struct("page_no", "ordinal")).alias("at"))
    )
    return reject_rows(
        first,
        "artifact_id",
        Code.PARSER_ERROR,
        "block without label",
        F.format_string("p%d-b%d", F.col("at.page_no"), F.col("at.ordinal")),
    )


def map_block_type(blocks: DataFrame) -> DataFrame:
    mapped = literal_map(BLOCK_TYPE_OF_LABEL)[F.col("label")]
    return blocks.withColumn("block_type", F.coalesce(mapped, F.lit("text")))


def flag_claim_exclusion(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("exclude_from_claims", F.col("label").isin(*NOT_CLAIM_LABELS))


def bad_box() -> Column:
    """True unless all four coordinates are finite and ordered from a non-negative origin."""
    infinite = F.lit(float("inf"))
    bad = F.lit(False)
    for low, high in (("x0", "x1"), ("y0", "y1")):
        a, b = F.col(low).cast("double"), F.col(high).cast("double")
        fine = ~F.isnan(a) & ~F.isnan(b) & (a >= 0) & (a <= b) & (b < infinite)
        bad = bad | ~F.coalesce(fine, F.lit(False))
    return bad


def validate_bbox(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One bad box voids the artifact; the first bad block in document order is the offender."""
    first_bad = (
        blocks.filter(bad_box())
        .groupBy("artifact_id")
        .agg(F.min(F.struct("page_no", "ordinal")).alias("at"))
    )
    rejects = reject_rows(
        first_bad,
        "artifact_id",
        Code.PARSER_ERROR,
        "invalid bounding box",
        F.format_string("p%d-b%d", F.col("at.page_no"), F.col("at.ordinal")),
    )
    return drop_units(blocks, rejects, "artifact_id"), rejects


def block_external_ids(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("external_id", F.format_string("p%d-b%d", "page_no", "ordinal"))


def section_external_id(ordinal: Column) -> Column:
    return F.when(ordinal.isNotNull(), F.concat(F.lit("section-"), ordinal.cast("string")))


def extract_citations(blocks: DataFrame) -> DataFrame:
    """Distinct citation markers in first-seen order, and the number of matches."""
    found = text.citation_matches(F.col("content"))
    return (
        blocks.withColumn("_found", found)
        .withColumn("markers", F.array_distinct("_found"))
        .withColumn("n_matches", F.size("_found"))
        .drop("_found")
    )


def page_segments(blocks: DataFrame, pages: int = PAGES_PER_SEGMENT) -> DataFrame:
    return blocks.withColumn(SEGMENT, F.floor(F.col("page_no") / pages).cast("int"))


def assign_sections(blocks: DataFrame, pages: int = PAGES_PER_SEGMENT) -> DataFrame:
    """``section_ordinal``: the section opened last at or before the block, null before any."""
    opened = F.col("label").isin(*HEADING_LABELS).cast("int")
    counted = segmented_scan(
        page_segments(blocks, pages),
        ["artifact_id"],
        ["page_no", "ordinal"],
        [Running("_opened", opened)],
    )
    return counted.withColumn(
        "section_ordinal", F.when(F.col("_opened") > 0, (F.col("_opened") - 1).cast("int"))
    ).drop("_opened", SEGMENT)


def detect_sections(blocks: DataFrame, pages: int = PAGES_PER_SEGMENT) -> DataFrame:
    """One row per heading block: ordinal from 0, level from its number, title and first page.

    The scan sees keys and labels of all blocks but the text of headings alone.
    """
    title = F.when(F.col("label").isin(*HEADING_LABELS), F.col("content"))
    slim = blocks.select("artifact_id", "page_no", "ordinal", "label", title.alias("content"))
    return headings_as_sections(assign_sections(slim, pages))


def headings_as_sections(assigned: DataFrame) -> DataFrame:
    """Sections from blocks that already carry ``section_ordinal``."""
    return assigned.filter(F.col("label").isin(*HEADING_LABELS)).select(
        "artifact_id",
        F.col("section_ordinal").alias("ordinal"),
        text.heading_level(F.col("content")).alias("level"),
        F.col("content").alias("title"),
        F.col("page_no").alias("page_start"),
    )


def section_parents(sections: DataFrame, per_segment: int = SEGMENT_ROWS) -> DataFrame:
    """``parent_ordinal``: the nearest earlier section with a strictly smaller level."""
    return nearest_smaller(sections, "artifact_id", "ordinal", "level", "parent_ordinal", rows=per_segment)


def section_successors(sections: DataFrame, per_segment: int = SEGMENT_ROWS) -> DataFrame:
    """``next_ordinal``: the section that closes this one, null when the document end does."""
    return nearest_smaller(
        sections, "artifact_id", "ordinal", "level", "next_ordinal", later=True, equal=True, rows=per_segment
    )


def section_page_spans(
    sections: DataFrame,
    assigned: DataFrame,
    per_segment: int = SEGMENT_ROWS,
) -> DataFrame:
    """``page_end``: the page of the last block before the section is closed.

    Pages never fall along a document, so that is the last page of the section just before the
    closing one, or the last page of the document. ``assigned`` needs only ``artifact_id``,
    ``page_no`` and ``section_ordinal``.
    """
    closed = section_successors(sections, per_segment)
    extents = (
        assigned.filter(F.col("section_ordinal").isNotNull())
        .groupBy("artifact_id", "section_ordinal")
        .agg(F.max("page_no").alias("_last_page"))
    )
    ends = assigned.groupBy("artifact_id").agg(F.max("page_no").alias("_document_end"))
    with_next = closed.join(
        extents.withColumnRenamed("artifact_id", "_artifact"),
        (F.col("artifact_id") == F.col("_artifact"))
        & (F.col("next_ordinal") - 1 == F.col("section_ordinal")),
        "left",
    ).drop("_artifact", "section_ordinal")
    return (
        with_next.join(ends, "artifact_id", "left")
        .withColumn("page_end", F.coalesce("_last_page", "_document_end"))
        .drop("_last_page", "_document_end", "next_ordinal")
    )


def reading_order(blocks: DataFrame) -> DataFrame:
    """Slot of each block on its page: a block takes one, each of its citations one more.

    ``blocks`` carries ``n_matches``.
    """
    cut = blocks.withColumn(
        SEGMENT, F.floor(F.col("ordinal") / BLOCKS_PER_SEGMENT).cast("int")
    )
    slots = Running("_slots", F.col("n_matches") + 1, inclusive=False)
    scanned = segmented_scan(cut, ["artifact_id", "page_no"], ["ordinal"], [slots])
    return scanned.withColumn("reading_order", F.col("_slots").cast("int")).drop("_slots", SEGMENT)


def order_and_assign(blocks: DataFrame, pages: int = PAGES_PER_SEGMENT) -> DataFrame:
    """``reading_order`` and ``section_ordinal`` together, over one shuffle of the blocks.

    The scan over runs of pages comes first; its partitioning and sort order also serve the
    window over single pages. Markers, and the matches that take slots, are found after the move unless
    ``blocks`` has them.
    """
    opened = Running("_opened", F.col("label").isin(*HEADING_LABELS).cast("int"))
    counted = segmented_scan(
        page_segments(blocks, pages), ["artifact_id"], ["page_no", "ordinal"], [opened]
    )
    if "n_matches" not in counted.columns:
        counted = extract_citations(counted)
    page = Window.partitionBy("artifact_id", SEGMENT, "page_no").orderBy("ordinal")
    slots = F.sum(F.col("n_matches") + 1).over(page.rowsBetween(Window.unboundedPreceding, -1))
    return counted.withColumns(
        {
            "reading_order": F.coalesce(slots, F.lit(0)).cast("int"),
            "section_ordinal": F.when(F.col("_opened") > 0, (F.col("_opened") - 1).cast("int")),
        }
    ).drop("_opened", SEGMENT)


def citation_positions(blocks: DataFrame) -> DataFrame:
    """One row per citation match with its code-point span and its slot on the page.

    ``blocks`` carries ``external_id``, ``section_ordinal`` and ``reading_order``. Spans add up
    the lengths of the gaps and matches before; only markers and lengths are shuffled.
    """
    found = text.citation_matches(F.col("content"))
    gaps = F.transform(F.split("content", text.CITATION, -1), F.char_length)
    pairs = F.arrays_zip(found.alias("marker"), gaps.alias("gap"))
    exploded = blocks.filter(F.size(found) > 0).select(
        "artifact_id",
        "page_no",
        "ordinal",
        F.col("external_id").alias("parent_external_id"),
        "section_ordinal",
        "reading_order",
        "x0",
        "y0",
        "x1",
        "y1",
        F.posexplode(pairs).alias("index", "pair"),
    )
    within = Window.partitionBy("artifact_id", "page_no", "ordinal").orderBy("index")
    ends = F.sum(F.col("pair.gap") + F.char_length("pair.marker")).over(
        within.rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        exploded.filter(F.col("pair.marker").isNotNull())
        .withColumn("span_end", ends.cast("int"))
        .select(
            "artifact_id",
            "page_no",
            F.format_string("%s-citation-%d", "parent_external_id", "index").alias("external_id"),
            "parent_external_id",
            "section_ordinal",
            F.lit("citation").alias("block_type"),
            (F.col("reading_order") + 1 + F.col("index")).alias("reading_order"),
            F.col("pair.marker").alias("content"),
            F.array("pair.marker").alias("markers"),
            "x0",
            "y0",
            "x1",
            "y1",
            (F.col("span_end") - F.char_length("pair.marker")).alias("span_start"),
            "span_end",
        )
    )


def union_blocks(blocks: DataFrame, citations: DataFrame) -> DataFrame:
    """Parsed blocks and derived citation blocks as one table."""
    return blocks.unionByName(citations, allowMissingColumns=True)


# The references of a block, in the order they are checked.
REFERENCES = {
    "section_external_id": "unknown section",
    "parent_external_id": "unknown parent block",
    "caption_external_id": "unknown caption block",
}


def unknown_block_references(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Rejects of artifacts with a reference to a section or block that does not exist.

    Only the *distinct* references meet their target table.
    """
    references = F.array(
        *(
            F.struct(
                F.lit(rank).alias("rank"), F.col(column).alias("target"), F.lit(text).alias("message")
            )
            for rank, (column, text) in enumerate(REFERENCES.items())
            if column in blocks.columns
        )
    )
    wanted = (
        blocks.select("artifact_id", F.explode(references).alias("ref"))
        .select("artifact_id", "ref.*")
        .filter(F.col("target").isNotNull())
        .distinct()
    )
    known_sections = sections.select("artifact_id", F.col("external_id").alias("target"))
    known_blocks = blocks.select("artifact_id", F.col("external_id").alias("target"))
    key = ["artifact_id", "target"]
    lost = (
        wanted.filter("rank = 0")
        .join(known_sections, key, "left_anti")
        .unionByName(wanted.filter("rank > 0").join(known_blocks, key, "left_anti"))
    )
    first = lost.groupBy("artifact_id").agg(
        F.min(F.struct("rank", "target", "message")).alias("lost")
    )
    return reject_rows(
        first, "artifact_id", Code.INTERNAL_ERROR, F.col("lost.message"), F.col("lost.target")
    )


def with_table_ids(blocks: DataFrame) -> DataFrame:
    """Table ids of a block and of what it refers to: hashes of natural keys, no join."""
    unit = F.col("artifact_id")
    return blocks.withColumns(
        {
            "id": ids.table_id(unit, F.col("external_id")),
            "section_id": ids.table_id(unit, F.col("section_external_id")),
            "parent_block_id": ids.table_id(unit, F.col("parent_external_id")),
            "caption_block_id": ids.table_id(unit, F.col("caption_external_id")),
        }
    )


def resolve_block_references(
    blocks: DataFrame, sections: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Replace external ids of section, parent block and caption block by table ids.

    A null reference stays null; an unknown one voids the artifact.
    """
    rejects = unknown_block_references(blocks, sections)
    return with_table_ids(drop_units(blocks, rejects, "artifact_id")), rejects
