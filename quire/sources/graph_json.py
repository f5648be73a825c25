"""Raw code-graph documents, one JSON text per graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.rejects import Code, reject_rows
from quire.session import materialize

# Document shape, failure flags, quota.
NODE_ARRAY = (
    "ARRAY<STRUCT<id: STRING, label: STRING, source_file: STRING, source_location: STRING, "
    "confidence: STRING, confidence_score: DOUBLE, type: STRING, "
    "metadata: STRUCT<kind: STRING, type: STRING>, _callable_class: BOOLEAN, _callable: BOOLEAN>>"
)
EDGE_ARRAY = (
    "ARRAY<STRUCT<source: STRING, target: STRING, relation: STRING, source_file: STRING, "
    "source_location: STRING, confidence: STRING, confidence_score: DOUBLE>>"
)
FAILURE_FLAGS = ("errors", "error", "failed_sources", "worker_warnings")
MAX_GRAPH_BYTES = 32 * 1024 * 1024


def _truthy(found: Column) -> Column:
    """Whether a variant holds something: a non-empty list, object or text, a non-zero number."""
    kind = F.coalesce(F.schema_of_variant(found), F.lit("VOID"))
    shown = F.to_json(found)
    return (
        F.when(kind == "VOID", False)
        .when(kind == "BOOLEAN", shown == "true")
        .when(kind.rlike("^(STRING|ARRAY|OBJECT)"), ~shown.isin('""', "[]", "{}"))
        .otherwise(F.coalesce(shown.try_cast("double") != 0, F.lit(True)))
    )


def read_code_graph(
    documents: DataFrame, max_bytes: int = MAX_GRAPH_BYTES
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(raw_nodes, raw_edges, graphs, rejects)`` of ``(graph_id, json)`` documents.

    Documents are parsed once into a table; the outputs read the columns they need from it.
    """
    flags = ", ".join(f"{field} VARIANT" for field in FAILURE_FLAGS)
    shape = f"nodes {NODE_ARRAY}, edges {EDGE_ARRAY}, {flags}"
    size = F.octet_length("json")
    failed = F.lit(False)
    for field in FAILURE_FLAGS:
        failed = failed | _truthy(F.col(f"g.{field}"))
    parsed = materialize(
        documents.select(
            "graph_id",
            size.alias("_size"),
            F.from_json(F.when(size <= max_bytes, F.col("json")), shape).alias("g"),
        ).select("graph_id", "_size", "g.nodes", "g.edges", failed.alias("parse_failed"))
    )
    message = F.when(F.col("_size") > max_bytes, "output exceeds quota").when(
        F.col("nodes").isNull() | F.col("edges").isNull(), "no lists of nodes and edges"
    )
    rejects = reject_rows(
        parsed.filter(message.isNotNull()), "graph_id", Code.PARSER_ERROR, message, F.col("_size")
    )
    sound = parsed.filter(message.isNull())
    nodes = sound.select(
        "graph_id", F.explode("nodes").alias("n")
    ).select(
        "graph_id",
        "n.id",
        "n.label",
        "n.source_file",
        "n.source_location",
        "n.confidence",
        "n.confidence_score",
        "n.type",
        F.col("n.metadata.kind").alias("metadata_kind"),
        F.col("n.metadata.type").alias("metadata_type"),
        F.coalesce("n._callable_class", F.lit(False)).alias("callable_class"),
        F.coalesce("n._callable", F.lit(False)).alias("callable"),
    )
    edges = sound.select(
        "graph_id", F.explode("edges").alias("e")
    ).select("graph_id", "e.*")
    graphs = sound.select("graph_id", "parse_failed")
    return nodes, edges, graphs, rejects


