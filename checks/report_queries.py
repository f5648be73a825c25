"""Queries over page layouts: typing, outline, order, citations, captions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import register
from quire.operators import captions, hierarchy
from quire.operators import layout as L
from quire.plans import report
from quire.session import scratch_folder
from quire.sources.layout import blocks_of, pages_of
from quire.sources.sinks import block_part, section_part
from quire.sources.store import Store

@register("""
    SELECT o.artifact_id, o.ordinal::BIGINT AS section_ordinal, o.title, o.level::BIGINT AS level,
           (SELECT count(*) FROM parsed b WHERE b.artifact_id = o.artifact_id
              AND b.section_ordinal = o.ordinal AND b.block_type = 'text') AS text_blocks,
           (SELECT count(DISTINCT m) FROM
              (SELECT unnest(b.markers) AS m FROM parsed b WHERE b.artifact_id = o.artifact_id
                 AND b.section_ordinal = o.ordinal)) AS distinct_markers
    FROM sections o""")
def section_outline(spark, d):
    """For each document its sections with their text blocks and distinct citation markers."""
    blocks = I.parsed_blocks(spark, d)
    sections = L.headings_as_sections(blocks)
    # per (section, marker) first: the second aggregate counts distinct markers without a set
    per_marker = blocks.select(
        "artifact_id",
        "section_ordinal",
        (F.col("block_type") == "text").alias("is_text"),
        F.posexplode_outer("markers").alias("nth", "marker"),
    )
    counted = (
        per_marker.groupBy("artifact_id", "section_ordinal", "marker")
        .agg(F.count_if(F.col("is_text") & (F.coalesce("nth", F.lit(0)) == 0)).alias("texts"))
        .groupBy("artifact_id", "section_ordinal")
        .agg(
            F.sum("texts").alias("text_blocks"),
            F.count("marker").alias("distinct_markers"),
        )
    )
    return (
        sections.withColumnRenamed("ordinal", "section_ordinal")
        .join(counted, ["artifact_id", "section_ordinal"])
        .select(
            "artifact_id", "section_ordinal", "title", "level", "text_blocks", "distinct_markers"
        )
    )


def ocr_texts(spark, d) -> DataFrame:
    """The layout blocks of each document written out as one OCR result text.

    Every page is one line; a page holds eight blocks and a document is one text cell.
    """
    block = F.struct(
        "ordinal",
        F.struct(
            F.col("label").alias("block_label"),
            F.col("content").alias("block_content"),
            F.array("x0", "y0", "x1", "y1").alias("block_bbox"),
            F.col("ordinal").cast("string").alias("block_id"),
        ).alias("block"),
    )
    pages = (
        I.layout_blocks(spark, d)
        .groupBy("artifact_id", "page_no")
        .agg(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["block"]).alias("l"))
    )
    page = F.struct(F.struct(F.col("l").alias("parsing_res_list")).alias("prunedResult"))
    line = F.to_json(F.struct(F.struct(F.array(page).alias("layoutParsingResults")).alias("result")))
    texts = pages.select("artifact_id", F.struct("page_no", line.alias("line")).alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["line"]), "\n")
    return texts.groupBy("artifact_id").agg(joined.alias("value"))


@register("""
    SELECT artifact_id, page_no, ordinal, ordinal::VARCHAR AS block_id, label, content,
           x0::BIGINT AS x0, y0::BIGINT AS y0, x1::BIGINT AS x1, y1::BIGINT AS y1
    FROM layout_blocks""")
def read_layout_blocks(spark, d):
    blocks = blocks_of(pages_of(ocr_texts(spark, d)))
    return blocks.select(
        "artifact_id",
        "page_no",
        "ordinal",
        "block_id",
        "label",
        "content",
        *(F.col(c).cast("bigint").alias(c) for c in ("x0", "y0", "x1", "y1")),
    )


def _pages(spark, d) -> DataFrame:
    """A page per document line group; every seventh document brings no list on its pages."""
    pages = (
        I.layout_blocks(spark, d)
        .groupBy("artifact_id", "page_no")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    listed = F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("{}"), F.col("n").cast("int")),
                                               ","), F.lit("]"))
    body = F.when(F.expr("artifact_id % 7 = 0"), F.lit('{"a":1}')).otherwise(listed)
    return pages.select(
        "artifact_id",
        "page_no",
        F.concat(F.lit('{"parsing_res_list":'), body, F.lit("}")).alias("page_json"),
    )


@register("""
    SELECT artifact_id::VARCHAR AS unit_id, 'parser_error' AS code,
           CASE WHEN bytes > 200 THEN 'output exceeds quota' ELSE 'invalid page blocks' END
             AS message,
           CASE WHEN bytes > 200 THEN bytes ELSE 1 END::VARCHAR AS offender
    FROM (SELECT artifact_id,
                 sum(21 + CASE WHEN artifact_id % 7 = 0 THEN 7 ELSE 3 * n + 1 END)::BIGINT AS bytes
          FROM (SELECT artifact_id, page_no, count(*) AS n FROM layout_blocks GROUP BY ALL)
          GROUP BY artifact_id)
    WHERE bytes > 200 OR artifact_id % 7 = 0""")
def audit_layout_output(spark, d):
    return L.audit_layout_output(_pages(spark, d), max_bytes=200)[1]


@register("SELECT artifact_id, page_no, ordinal, label, block_type FROM parsed")
def map_block_type(spark, d):
    return L.map_block_type(I.layout_blocks(spark, d)).select(
        "artifact_id", "page_no", "ordinal", "label", "block_type"
    )


@register("SELECT artifact_id, page_no, ordinal, exclude_from_claims FROM parsed")
def flag_claim_exclusion(spark, d):
    return L.flag_claim_exclusion(I.layout_blocks(spark, d)).select(
        "artifact_id", "page_no", "ordinal", "exclude_from_claims"
    )


@register("""
    SELECT artifact_id::VARCHAR AS unit_id, 'parser_error' AS code,
           'invalid bounding box' AS message,
           'p' || (i // 8 + 1) || '-b' || (i % 8) AS offender
    FROM (SELECT doc_id AS artifact_id, min(i) AS i FROM doc_lines
          WHERE (doc_id * 5 + i) % 97 = 0 GROUP BY doc_id)""")
def validate_bbox(spark, d):
    return L.validate_bbox(I.damaged_blocks(spark, d))[1]


@register("""
    SELECT artifact_id, count(*) AS n_blocks FROM layout_blocks
    WHERE artifact_id NOT IN (SELECT doc_id FROM doc_lines WHERE (doc_id * 5 + i) % 97 = 0)
    GROUP BY artifact_id""")
def validate_bbox_accepted(spark, d):
    kept = L.validate_bbox(I.damaged_blocks(spark, d))[0]
    return kept.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n_blocks"))


@register("SELECT artifact_id, page_no, ordinal, external_id FROM parsed")
def block_external_ids(spark, d):
    return L.block_external_ids(I.layout_blocks(spark, d)).select(
        "artifact_id", "page_no", "ordinal", "external_id"
    )


@register("""
    SELECT artifact_id, page_no, ordinal, n_matches, array_to_string(markers, '|') AS markers
    FROM parsed""")
def extract_citations(spark, d):
    return L.extract_citations(I.layout_blocks(spark, d)).select(
        "artifact_id",
        "page_no",
        "ordinal",
        "n_matches",
        F.array_join("markers", "|").alias("markers"),
    )


@register("""
    SELECT artifact_id, ordinal, level::BIGINT AS level, title, page_start FROM sections""")
def detect_sections(spark, d):
    return L.detect_sections(I.layout_blocks(spark, d))


@register("SELECT artifact_id, ordinal, level::BIGINT AS level, parent_ordinal FROM outline")
def section_parents(spark, d):
    sections = L.detect_sections(I.layout_blocks(spark, d))
    return L.section_parents(sections.select("artifact_id", "ordinal", "level"))


@register("SELECT artifact_id, ordinal, page_start, page_end FROM spans")
def section_page_spans(spark, d):
    blocks = I.layout_blocks(spark, d)
    slim = blocks.select("artifact_id", "page_no", "ordinal", "label")
    assigned = L.assign_sections(slim)
    sections = L.detect_sections(blocks).select("artifact_id", "ordinal", "level", "page_start")
    return L.section_page_spans(sections, assigned).select(
        "artifact_id", "ordinal", "page_start", "page_end"
    )


@register("SELECT artifact_id, page_no, ordinal, section_ordinal FROM parsed")
def assign_sections(spark, d):
    return L.assign_sections(
        I.layout_blocks(spark, d).select("artifact_id", "page_no", "ordinal", "label")
    ).select("artifact_id", "page_no", "ordinal", "section_ordinal")


@register("SELECT artifact_id, page_no, ordinal, reading_order FROM parsed")
def reading_order(spark, d):
    counted = L.extract_citations(I.layout_blocks(spark, d)).select(
        "artifact_id", "page_no", "ordinal", "n_matches"
    )
    return L.reading_order(counted).drop("n_matches")


@register("""
    SELECT artifact_id, page_no, external_id, parent_external_id, section_ordinal, reading_order,
           content, span_start, span_end
    FROM citations""")
def citation_positions(spark, d):
    return L.citation_positions(I.parsed_blocks(spark, d)).select(
        "artifact_id",
        "page_no",
        "external_id",
        "parent_external_id",
        "section_ordinal",
        "reading_order",
        "content",
        "span_start",
        "span_end",
    )


@register("""
    SELECT artifact_id, page_no, reading_order, external_id, block_type,
           NULL::VARCHAR AS parent_external_id, section_ordinal, x0::BIGINT AS x0
    FROM parsed
    UNION ALL
    SELECT artifact_id, page_no, reading_order, external_id, 'citation', parent_external_id,
           section_ordinal, x0::BIGINT FROM citations""")
def union_blocks(spark, d):
    blocks = I.parsed_blocks(spark, d)
    return L.union_blocks(blocks, L.citation_positions(blocks)).select(
        "artifact_id",
        "page_no",
        "reading_order",
        "external_id",
        "block_type",
        "parent_external_id",
        "section_ordinal",
        F.col("x0").cast("bigint").alias("x0"),
    )


@register("""
    SELECT b.artifact_id, b.page_no, b.external_id, l.caption AS caption_external_id,
           CASE WHEN l.caption IS NOT NULL THEN 'nearest_vertical_overlap' END
             AS caption_link_method
    FROM parsed b LEFT JOIN caption_links l USING (artifact_id, page_no, ordinal)""")
def link_captions(spark, d):
    return captions.link_captions(I.parsed_blocks(spark, d)).select(
        "artifact_id", "page_no", "external_id", "caption_external_id", "caption_link_method"
    )


def _tree(spark, d) -> DataFrame:
    sections = L.section_parents(L.detect_sections(I.layout_blocks(spark, d)))
    return sections.withColumn(
        "external_id", L.section_external_id(F.col("ordinal"))
    ).withColumn("parent_external_id", L.section_external_id(F.col("parent_ordinal")))


@register("""
    SELECT artifact_id, ordinal, array_to_string(path, ' > ') AS section_path FROM section_tree""")
def section_paths(spark, d):
    return hierarchy.section_paths(_tree(spark, d))[0].select(
        "artifact_id", "ordinal", F.array_join("section_path", " > ").alias("section_path")
    )


@register("""
    SELECT artifact_id::VARCHAR AS unit_id, 'internal_error' AS code,
           CASE WHEN artifact_id % 6 = 0 THEN 'section parent cycle'
                ELSE 'unknown parent section' END AS message,
           CASE WHEN artifact_id % 6 = 0 THEN 'section-0' ELSE 'section-none' END AS offender
    FROM (SELECT DISTINCT artifact_id FROM sections)
    WHERE artifact_id % 6 = 0 OR artifact_id % 5 = 0""")
def section_path_rejects(spark, d):
    """Roots bent to an unknown parent in some documents and onto themselves in others."""
    root = F.col("ordinal") == 0
    bent = _tree(spark, d).withColumn(
        "parent_external_id",
        F.when(root & F.expr("artifact_id % 6 = 0"), F.col("external_id"))
        .when(root & F.expr("artifact_id % 5 = 0"), "section-none")
        .otherwise(F.col("parent_external_id")),
    )
    return hierarchy.section_paths(bent)[1]


@register("""
    SELECT artifact_id::VARCHAR AS unit_id, 'internal_error' AS code, 'unknown section' AS message,
           'section-9999' AS offender
    FROM (SELECT DISTINCT artifact_id FROM parsed
          WHERE (artifact_id + page_no * 8 + ordinal) % 211 = 0)""")
def resolve_block_references(spark, d):
    blocks = captions.link_captions(I.parsed_blocks(spark, d)).withColumn(
        "parent_external_id", F.lit(None).cast("string")
    )
    lost = F.expr("(artifact_id + page_no * 8 + ordinal) % 211 = 0")
    named = blocks.withColumn(
        "section_external_id",
        F.when(lost, "section-9999").otherwise(L.section_external_id(F.col("section_ordinal"))),
    )
    sections = L.headings_as_sections(blocks).withColumn(
        "external_id", L.section_external_id(F.col("ordinal"))
    )
    return L.resolve_block_references(named, sections)[1]


@register("""
    SELECT artifact_id, page_no, reading_order, block_type,
           sha256(artifact_id || '|' || external_id) AS id,
           CASE WHEN section_ordinal IS NOT NULL
                THEN sha256(artifact_id || '|section-' || section_ordinal) END AS section_id,
           CASE WHEN parent_external_id IS NOT NULL
                THEN sha256(artifact_id || '|' || parent_external_id) END AS parent_block_id,
           CASE WHEN caption IS NOT NULL
                THEN sha256(artifact_id || '|' || caption) END AS caption_block_id,
           content
    FROM (SELECT b.artifact_id, b.page_no, b.reading_order, b.block_type, b.external_id,
                 b.section_ordinal, NULL::VARCHAR AS parent_external_id, l.caption, b.content
          FROM parsed b LEFT JOIN caption_links l USING (artifact_id, page_no, ordinal)
          UNION ALL
          SELECT artifact_id, page_no, reading_order, 'citation', external_id, section_ordinal,
                 parent_external_id, NULL, content FROM citations)
    WHERE artifact_id NOT IN (SELECT doc_id FROM doc_lines WHERE (doc_id * 5 + i) % 97 = 0)""")
def build_report_tables(spark, d):
    built = report.build_report_tables(I.damaged_blocks(spark, d))
    return built.blocks.select(
        "artifact_id",
        "page_no",
        "reading_order",
        "block_type",
        "id",
        "section_id",
        "parent_block_id",
        "caption_block_id",
        "content",
    )


@register("""
    SELECT s.artifact_id, s.ordinal, s.level::BIGINT AS level, s.parent_ordinal, s.page_start,
           s.page_end, array_to_string(t.path, ' > ') AS section_path
    FROM spans s JOIN section_tree t USING (artifact_id, ordinal)
    WHERE artifact_id NOT IN (SELECT doc_id FROM doc_lines WHERE (doc_id * 5 + i) % 97 = 0)""")
def build_report_sections(spark, d):
    built = report.build_report_tables(I.damaged_blocks(spark, d))
    return built.sections.select(
        "artifact_id",
        "ordinal",
        "level",
        "parent_ordinal",
        "page_start",
        "page_end",
        F.array_join("section_path", " > ").alias("section_path"),
    )


@register("""
    SELECT b.artifact_id::VARCHAR AS artifact_id, b.page_no, b.reading_order,
           b.content AS text_content, array_to_string(b.markers, '|') AS markers,
           'layout-1' AS parser_version,
           (SELECT s.level FROM sections s WHERE s.artifact_id = b.artifact_id
              AND s.ordinal = b.section_ordinal)::BIGINT AS section_level
    FROM parsed b
    UNION ALL
    SELECT c.artifact_id::VARCHAR, c.page_no, c.reading_order, c.content, c.content, 'layout-1',
           (SELECT s.level FROM sections s WHERE s.artifact_id = c.artifact_id
              AND s.ordinal = c.section_ordinal)::BIGINT
    FROM citations c""")
def write_document_tables(spark, d):
    """Sections and blocks written as tables, read back and joined on their table ids."""
    built = report.build_report_tables(I.layout_blocks(spark, d))
    out = scratch_folder(spark)
    store = Store(spark, out)
    store.write([section_part(built.sections), block_part(built.blocks, "layout-1")])
    blocks, sections = store.read("document_blocks"), store.read("document_sections")
    levels = sections.select(F.col("id").alias("section_id"), F.col("level").alias("section_level"))
    return blocks.join(levels, "section_id", "left").select(
        "artifact_id",
        "page_no",
        "reading_order",
        "text_content",
        F.array_join("citation_marker_ids", "|").alias("markers"),
        "parser_version",
        "section_level",
    )
