"""Layout blocks to document tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import captions, hierarchy
from quire.operators import layout as L
from quire.operators.code_graph import audit_duplicate_ids
from quire.rejects import drop_units, union_rejects
from quire.session import materialize
from quire.sources.layout import page_blocks


class ReportTables(NamedTuple):
    sections: DataFrame
    blocks: DataFrame
    rejects: DataFrame


def audited_report_tables(
    pages: DataFrame, max_bytes: int = L.MAX_OCR_BYTES
) -> ReportTables:
    """The same from pages as a layout reader gives them; artifacts it cannot use are rejects.

    ``pages`` has ``(artifact_id, page_no, page_json)``, one row with null page for an artifact
    without pages.
    """
    return report_tables_of(read_pages(pages, max_bytes), max_bytes)


def read_pages(pages: DataFrame, max_bytes: int = L.MAX_OCR_BYTES) -> DataFrame:
    """The ``page_blocks``, written: whatever the pages come from is run once and their JSON parsed once."""
    return materialize(page_blocks(pages, max_bytes))


def report_tables_of(read: DataFrame, max_bytes: int = L.MAX_OCR_BYTES) -> ReportTables:
    """``audited_report_tables`` of pages that ``read_pages`` has read."""
    unusable = materialize(L.audit_pages(read.filter("coalesce(ordinal, 0) = 0"), max_bytes))
    blocks = read.filter("ordinal IS NOT NULL").drop("n_bytes", "page_bytes", "listed")
    built = _tables_of_written(drop_units(blocks, unusable, "artifact_id"))
    return built._replace(rejects=union_rejects(unusable, built.rejects))


def build_report_tables(layout_blocks: DataFrame) -> ReportTables:
    """Sections, blocks (with derived citation blocks) and rejects of all artifacts.

    Blocks are written as they come, since each audit and the numbering read some of their columns. They
    are shuffled once to be numbered and assigned to sections and are then materialised;
    the outline, the captions and the citations branch off that copy. Outline work sees headings
    only, captions see boxes only; only the final blocks carry text.
    """
    return _tables_of_written(materialize(layout_blocks))


def _tables_of_written(layout_blocks: DataFrame) -> ReportTables:
    _, bad_boxes = L.validate_bbox(layout_blocks)
    bad_boxes = materialize(union_rejects(L.audit_labels(layout_blocks), bad_boxes))
    ordered = L.order_and_assign(drop_units(layout_blocks, bad_boxes, "artifact_id"))
    typed = L.flag_claim_exclusion(L.map_block_type(ordered))
    blocks = materialize(L.block_external_ids(typed))

    sections = materialize(L.headings_as_sections(blocks))
    placed = L.section_page_spans(L.section_parents(sections), blocks)
    named = placed.withColumn(
        "external_id", L.section_external_id(F.col("ordinal"))
    ).withColumn("parent_external_id", L.section_external_id(F.col("parent_ordinal")))
    with_paths, bad_trees = hierarchy.section_paths(named)

    linked = captions.link_captions(blocks, materialize(captions.caption_links(blocks)))
    linked = linked.withColumn(
        "section_external_id", L.section_external_id(F.col("section_ordinal"))
    )
    # citations are derived from blocks and refer to nothing their block does not
    lost = L.unknown_block_references(linked, named)
    repeated = audit_duplicate_ids(blocks, "artifact_id", ["external_id"], "block id")
    citations = L.citation_positions(blocks).withColumn(
        "section_external_id", L.section_external_id(F.col("section_ordinal"))
    )
    resolved = L.with_table_ids(L.union_blocks(linked, citations))
    rejects = materialize(union_rejects(bad_boxes, bad_trees, repeated, lost))
    return ReportTables(
        drop_units(with_paths, rejects, "artifact_id"),
        drop_units(resolved, rejects, "artifact_id"),
        rejects,
    )
