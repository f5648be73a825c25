"""Queries over code graphs, archives and source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import register
from quire.operators import archives as A
from quire.operators import code_graph as G
from quire.plans import code_graph as plan
from quire.session import materialize, scratch_folder
from quire.sources.graph_json import read_code_graph as read_graphs
from quire.sources.sinks import read_graph_elements, snapshot_rows
from quire.sources.sinks import write_graph_document as write_graph_document_of
from quire.sources.tables import read_table, write_table

VERSION = "1.2.3"


def _nodes(spark, d):
    return materialize(G.normalize_nodes(I.raw_nodes(spark, d), I.raw_edges(spark, d)))


def _edges(spark, d, nodes, *unread):
    """Normalised edges as a table, before deduplication, without columns that go ``unread``."""
    return materialize(G.normalize_edges(G.resolve_edges(I.raw_edges(spark, d), nodes)[0]).drop(*unread))


#: What an edge's id is made of: neither deduplication nor counts read it again.
ENDS = ("source", "target", "relation")


def _score(column="confidence"):
    return F.when(F.col(column).isNotNull(), F.format_string("%.2f", F.col(column)))


def _graph_texts(spark, d):
    """A graph document per line item: a part, the part it calls, and the call."""
    node = "named_struct('id', CAST({0} AS STRING), 'label', concat('p', {0}), 'source_file', {1})"
    return I.spread(I.table(spark, d, "lineitem")).selectExpr(
        "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS graph_id",
        "to_json(named_struct("
        f"'nodes', array({node.format('l_partkey', repr('/source/a.py'))},"
        f" {node.format('l_suppkey', repr('b.py'))}),"
        " 'edges', array(named_struct('source', CAST(l_partkey AS STRING), 'target',"
        " CAST(l_suppkey AS STRING), 'relation', 'calls', 'confidence_score', l_discount)),"
        " 'errors', IF(l_suppkey % 4 = 0, array('lost'), array()),"
        " 'error', CASE l_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'broken' END)) AS json",
    )


@register("""
    SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS graph_id,
           l_partkey::VARCHAR AS source, l_suppkey::VARCHAR AS target, 'calls' AS relation,
           printf('%.2f', l_discount) AS score
    FROM lineitem""")
def read_code_graph(spark, d):
    edges = read_graphs(_graph_texts(spark, d))[1]
    return edges.select(
        "graph_id", "source", "target", "relation", _score("confidence_score").alias("score")
    )


@register("""
    SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS graph_id,
           l_suppkey % 4 = 0 OR l_suppkey % 5 = 1 AS parse_failed
    FROM lineitem""")
def read_code_graph_flags(spark, d):
    return read_graphs(_graph_texts(spark, d))[2]


@register("""
    SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS graph_id,
           unnest([l_partkey::VARCHAR, l_suppkey::VARCHAR]) AS id,
           unnest(['/source/a.py', 'b.py']) AS source_file
    FROM lineitem""")
def read_code_graph_nodes(spark, d):
    return read_graphs(_graph_texts(spark, d))[0].select("graph_id", "id", "source_file")


@register("""
    SELECT graph_id, id, path, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line,
           provenance, printf('%.2f', confidence) AS confidence, reason, rule
    FROM edges""")
def normalize_graph_element(spark, d):
    return _edges(spark, d, _nodes(spark, d)).select(
        "graph_id",
        "id",
        "location.path",
        "location.start_line",
        "location.end_line",
        "provenance",
        _score().alias("confidence"),
        "reason",
        "rule",
    )


@register("SELECT graph_id, raw_id, kind FROM nodes")
def classify_node(spark, d):
    return G.classify_node(I.raw_nodes(spark, d), I.raw_edges(spark, d)).select(
        "graph_id", F.col("id").alias("raw_id"), "kind"
    )


@register("""
    SELECT graph_id, source, target, relation AS rule,
           CASE relation WHEN 'method' THEN 'declares' WHEN 'imports_from' THEN 'imports'
                ELSE relation END AS relation
    FROM raw_edges""")
def normalize_relation(spark, d):
    return G.normalize_relation(I.raw_edges(spark, d)).select(
        "graph_id", "source", "target", "rule", "relation"
    )


@register("SELECT graph_id, raw_id, id, name, kind, provenance, reason FROM nodes")
def stable_ids(spark, d):
    return G.normalize_nodes(I.raw_nodes(spark, d), I.raw_edges(spark, d)).select(
        "graph_id", "raw_id", "id", "name", "kind", "provenance", "reason"
    )


@register("SELECT graph_id, source, target, relation, source_location FROM resolved")
def resolve_edges(spark, d):
    resolved, _ = G.resolve_edges(I.raw_edges(spark, d), _nodes(spark, d))
    return resolved.select("graph_id", "source", "target", "relation", "source_location")


@register("SELECT graph_id, source, target, relation, source_location FROM unresolved")
def unresolved_edges(spark, d):
    _, loose = G.resolve_edges(I.raw_edges(spark, d), _nodes(spark, d))
    return loose.select("graph_id", "source", "target", "relation", "source_location")


@register("""
    SELECT graph_id::VARCHAR AS unit_id, 'parser_error' AS code, 'duplicate edge id' AS message,
           id AS offender
    FROM edges GROUP BY graph_id, id HAVING count(*) > 1""")
def audit_duplicate_ids(spark, d):
    edges = _edges(spark, d, _nodes(spark, d))
    return G.audit_duplicate_ids(edges, "graph_id", ["id"], "edge id")


@register("""
    SELECT graph_id, id, source, relation, target, provenance,
           printf('%.2f', confidence) AS confidence
    FROM unique_edges""")
def dedupe_edges(spark, d):
    return G.dedupe_edges(_edges(spark, d, _nodes(spark, d)))[0].select(
        "graph_id",
        "id",
        "source",
        "relation",
        "target",
        "provenance",
        _score().alias("confidence"),
    )


@register("""
    SELECT graph_id::VARCHAR AS unit_id, 'parser_error' AS code,
           'conflicting edge evidence' AS message, edge AS offender FROM conflicted""")
def dedupe_edge_rejects(spark, d):
    return G.dedupe_edges(_edges(spark, d, _nodes(spark, d), *ENDS))[1]


ELEMENTS = """
    SELECT graph_id, path, end_line FROM nodes WHERE path IS NOT NULL
    UNION ALL SELECT graph_id, path, end_line FROM edges WHERE path IS NOT NULL"""


@register(f"""
    SELECT e.graph_id::VARCHAR AS unit_id, 'parser_error' AS code, 'line outside file' AS message,
           e.path AS offender
    FROM ({ELEMENTS}) e JOIN inventory i ON i.graph_id = e.graph_id AND i.path = e.path
    GROUP BY e.graph_id, e.path, i.line_count HAVING max(e.end_line) > i.line_count""")
def audit_graph_locations(spark, d):
    nodes = _nodes(spark, d)
    elements = G.graph_elements(nodes, _edges(spark, d, nodes))
    return G.audit_graph_locations(elements, I.inventory(spark, d))


@register("""
    SELECT e.graph_id::VARCHAR AS unit_id, 'parser_error' AS code,
           'unknown edge endpoint' AS message, e.id AS offender
    FROM (SELECT graph_id, source AS id FROM raw_edges
          UNION SELECT graph_id, target FROM raw_edges) e
    WHERE NOT EXISTS (FROM raw_nodes n WHERE n.graph_id = e.graph_id AND n.id = e.id)""")
def audit_edge_endpoints(spark, d):
    return G.audit_edge_endpoints(I.raw_edges(spark, d), I.raw_nodes(spark, d))


@register("""
    SELECT graph_id::VARCHAR AS unit_id, 'parser_error' AS code,
           CASE WHEN confidence > 0.8 AND provenance = 'INFERRED' THEN 'confidence out of range'
                WHEN path LIKE '%1.py' AND provenance = 'EXTRACTED'
                THEN 'extracted element without source span'
                ELSE 'ambiguous element without reason' END AS message,
           id AS offender
    FROM (SELECT graph_id, id, path, confidence, provenance FROM nodes
          UNION ALL SELECT graph_id, id, path, confidence, provenance FROM edges)
    WHERE (confidence > 0.8 AND provenance = 'INFERRED')
       OR (path LIKE '%1.py' AND provenance = 'EXTRACTED') OR provenance = 'AMBIGUOUS'""")
def audit_graph_elements(spark, d):
    """Elements damaged by rule: some scores raised over one, some locations and reasons lost."""
    nodes = _nodes(spark, d)
    raised = (F.col("confidence") > 0.8) & (F.col("provenance") == "INFERRED")
    lost = (F.col("provenance") == "EXTRACTED") & F.col("location.path").endswith("1.py")
    damaged = G.graph_elements(nodes, _edges(spark, d, nodes)).withColumns(
        {
            "confidence": F.when(raised, 1.5).otherwise(F.col("confidence")),
            "location": F.when(~lost | F.col("location").isNull(), F.col("location")),
            "reason": F.lit(None).cast("string"),
        }
    )
    return G.audit_graph_elements(damaged, G.PARSER, VERSION)


@register("""
    SELECT graph_id, count(*) FILTER (WHERE n) AS node_count,
           count(*) FILTER (WHERE NOT n) AS edge_count
    FROM (SELECT graph_id, true AS n FROM nodes UNION ALL SELECT graph_id, false FROM unique_edges)
    GROUP BY graph_id""")
def graph_counts(spark, d):
    nodes = _nodes(spark, d)
    return G.graph_counts(nodes, G.dedupe_edges(_edges(spark, d, nodes, *ENDS))[0])


@register("""
    SELECT graph_id, provenance, count(*) AS n
    FROM (SELECT graph_id, provenance FROM nodes
          UNION ALL SELECT graph_id, provenance FROM unique_edges)
    GROUP BY graph_id, provenance""")
def provenance_summary(spark, d):
    nodes = _nodes(spark, d)
    summary = G.provenance_summary(nodes, G.dedupe_edges(_edges(spark, d, nodes, *ENDS))[0])
    return summary.select("graph_id", F.explode("provenance_summary").alias("provenance", "n"))


WARNINGS = """
    SELECT g.graph_id, list_sort(list_filter([
             CASE WHEN g.graph_id % 7 = 0 THEN 'graphify_partial_parse_failure' END,
             CASE WHEN NOT EXISTS (FROM nodes n WHERE n.graph_id = g.graph_id)
                  THEN 'no_structural_entities' END,
             CASE WHEN EXISTS (FROM nodes n WHERE n.graph_id = g.graph_id
                                 AND n.provenance = 'AMBIGUOUS')
                    OR EXISTS (FROM edges n WHERE n.graph_id = g.graph_id
                                 AND n.provenance = 'AMBIGUOUS') THEN 'unresolved_entities' END,
             CASE WHEN EXISTS (FROM unresolved u WHERE u.graph_id = g.graph_id)
                  THEN 'unresolved_edge_endpoint' END], lambda w: w IS NOT NULL)) AS warnings
    FROM (SELECT DISTINCT p_partkey % 50 + 20 AS graph_id FROM part) g"""


@register(f"""
    SELECT graph_id, array_to_string(warnings, ',') AS warnings,
           CASE WHEN len(warnings) > 0 THEN 'partial' ELSE 'complete' END AS status
    FROM ({WARNINGS})""")
def graph_warnings(spark, d):
    """Graphs 20 to 69, so that some have no elements at all."""
    nodes = _nodes(spark, d)
    edges = _edges(spark, d, nodes)
    loose = G.resolve_edges(I.raw_edges(spark, d), nodes)[1]
    graphs = (
        I.table(spark, d, "part")
        .selectExpr("p_partkey % 50 + 20 AS graph_id")
        .distinct()
        .withColumn("parse_failed", F.expr("graph_id % 7 = 0"))
    )
    return G.graph_warnings(graphs, nodes, edges, loose).select(
        "graph_id", F.array_join("warnings", ",").alias("warnings"), "status"
    )


@register("""
    SELECT graph_id, id, row_number() OVER (PARTITION BY graph_id ORDER BY id) AS position
    FROM nodes""")
def canonical_node_order(spark, d):
    return G.canonical_node_order(_nodes(spark, d)).select("graph_id", "id", "position")


@register("""
    SELECT graph_id, id, row_number() OVER (PARTITION BY graph_id
             ORDER BY source, relation, target, id) AS position
    FROM unique_edges""")
def canonical_edge_order(spark, d):
    edges = G.dedupe_edges(_edges(spark, d, _nodes(spark, d)))[0]
    return G.canonical_edge_order(edges).select("graph_id", "id", "position")


@register(f"""
    WITH bad AS (
      SELECT graph_id FROM conflicted UNION
      SELECT e.graph_id FROM ({ELEMENTS}) e JOIN inventory i
        ON i.graph_id = e.graph_id AND i.path = e.path WHERE e.end_line > i.line_count)
    SELECT graph_id, (SELECT count(*) FROM nodes n WHERE n.graph_id = g.graph_id) AS node_count,
           (SELECT count(*) FROM unique_edges n WHERE n.graph_id = g.graph_id) AS edge_count,
           CASE WHEN EXISTS (FROM nodes n WHERE n.graph_id = g.graph_id
                               AND n.provenance = 'AMBIGUOUS')
                  OR EXISTS (FROM edges n WHERE n.graph_id = g.graph_id
                               AND n.provenance = 'AMBIGUOUS')
                  OR EXISTS (FROM unresolved u WHERE u.graph_id = g.graph_id)
                THEN 'partial' ELSE 'complete' END AS status
    FROM (SELECT DISTINCT graph_id FROM nodes) g WHERE graph_id NOT IN (FROM bad)""")
def build_code_graph(spark, d):
    return _built(spark, d).documents.select("graph_id", "node_count", "edge_count", "status")


@register(f"""
    WITH bad AS (
      SELECT graph_id FROM conflicted UNION
      SELECT e.graph_id FROM ({ELEMENTS}) e JOIN inventory i
        ON i.graph_id = e.graph_id AND i.path = e.path WHERE e.end_line > i.line_count)
    SELECT graph_id::VARCHAR AS submission_id, 'a' || graph_id AS source_artifact_id,
           sha256(graph_id::VARCHAR) AS source_sha256, '1.2.3' AS graphify_version,
           (SELECT count(*) FROM nodes n WHERE n.graph_id = g.graph_id) AS node_count,
           (SELECT count(*) FROM unique_edges n WHERE n.graph_id = g.graph_id) AS edge_count,
           (SELECT count(*) FROM nodes n WHERE n.graph_id = g.graph_id
              AND n.provenance = 'EXTRACTED') + (SELECT count(*) FROM unique_edges n
              WHERE n.graph_id = g.graph_id AND n.provenance = 'EXTRACTED') AS extracted
    FROM (SELECT DISTINCT graph_id FROM nodes) g WHERE graph_id NOT IN (FROM bad)""")
def graph_snapshots(spark, d):
    """Snapshot rows of the accepted graphs, written and read back as their declared table."""
    documents = _built(spark, d).documents.withColumn("submission_id", F.col("graph_id"))
    folder = scratch_folder(spark)
    write_table(snapshot_rows(documents, VERSION), folder, "code_graph_snapshots")
    return read_table(spark, folder, "code_graph_snapshots").select(
        "submission_id",
        "source_artifact_id",
        "source_sha256",
        "graphify_version",
        "node_count",
        "edge_count",
        F.coalesce(F.col("provenance_summary")["EXTRACTED"], F.lit(0)).alias("extracted"),
    )


@register(f"""
    WITH bad AS (
      SELECT graph_id FROM conflicted UNION
      SELECT e.graph_id FROM ({ELEMENTS}) e JOIN inventory i
        ON i.graph_id = e.graph_id AND i.path = e.path WHERE e.end_line > i.line_count)
    SELECT graph_id, 'nodes' AS part, row_number() OVER (PARTITION BY graph_id ORDER BY id) AS position,
           id, name AS called, path, end_line::BIGINT AS last_line, provenance,
           round(confidence * 1000000)::BIGINT AS confidence
    FROM nodes WHERE graph_id NOT IN (FROM bad)
    UNION ALL
    SELECT graph_id, 'edges', row_number() OVER (PARTITION BY graph_id
             ORDER BY source, relation, target, id),
           id, relation, path, end_line::BIGINT, provenance, round(confidence * 1000000)::BIGINT
    FROM unique_edges WHERE graph_id NOT IN (FROM bad)
    UNION ALL
    SELECT graph_id, 'inventory', row_number() OVER (PARTITION BY graph_id ORDER BY path),
           NULL, NULL, path, line_count, NULL, NULL
    FROM inventory WHERE graph_id NOT IN (FROM bad)""")
def write_graph_document(spark, d):
    """The elements of all documents, in order, as read back from the written parts."""
    built = _built(spark, d)
    folder = scratch_folder(spark)
    write_graph_document_of(built.documents, built.parts, folder)
    location = "location STRUCT<path: STRING, end_line: BIGINT>"
    shapes = {
        "nodes": ("name", f"id STRING, name STRING, provenance STRING, confidence DOUBLE, {location}"),
        "edges": ("relation", f"id STRING, relation STRING, provenance STRING, confidence DOUBLE, {location}"),
    }
    files = read_graph_elements(spark, folder, "inventory", "path STRING, line_count BIGINT").select(
        "graph_id",
        F.lit("inventory").alias("part"),
        "position",
        F.lit(None).cast("string").alias("id"),
        F.lit(None).cast("string").alias("called"),
        F.col("element.path").alias("path"),
        F.col("element.line_count").alias("last_line"),
        F.lit(None).cast("string").alias("provenance"),
        F.lit(None).cast("bigint").alias("confidence"),
    )
    for part, (called, shape) in shapes.items():
        files = files.unionByName(
            read_graph_elements(spark, folder, part, shape).select(
                "graph_id",
                F.lit(part).alias("part"),
                "position",
                "element.id",
                F.col(f"element.{called}").alias("called"),
                F.col("element.location.path").alias("path"),
                F.col("element.location.end_line").alias("last_line"),
                "element.provenance",
                F.round(F.col("element.confidence") * 1000000).cast("bigint").alias("confidence"),
            )
        )
    return files


def _built(spark, d):
    graphs = (
        I.table(spark, d, "part")
        .selectExpr("p_partkey % 50 AS graph_id", "false AS parse_failed")
        .distinct()
    )
    sources = graphs.select(
        "graph_id",
        F.concat(F.lit("a"), "graph_id").alias("source_artifact_id"),
        F.sha2(F.col("graph_id").cast("string"), 256).alias("source_sha256"),
    )
    return plan.build_code_graph(
        I.raw_nodes(spark, d),
        I.raw_edges(spark, d),
        graphs,
        I.inventory(spark, d),
        sources,
        VERSION,
    )


@register("SELECT archive_id, entry_no, name, unsafe FROM member_paths")
def validate_member_path(spark, d):
    return A.validate_member_path(I.archive_members(spark, d)).select(
        "archive_id", "entry_no", "name", "unsafe"
    )


ADMISSION = """
    SELECT archive_id, n_entries,
           CASE WHEN n_entries > 9 THEN 'payload_too_large|too many entries'
                ELSE arg_min(fault, entry_no) FILTER (WHERE fault IS NOT NULL) END AS fault,
           CASE WHEN n_entries <= 9 THEN min(entry_no) FILTER (WHERE fault IS NOT NULL) END
             AS first_bad_entry
    FROM (SELECT *, CASE WHEN unsafe THEN 'bad_request|unsafe path'
                 WHEN nth > 1 OR mode = 'symlink' THEN 'bad_request|duplicate or special entry'
                 WHEN len(parts) > 5 OR file_size > 100000 OR declared > 250000
                   OR file_size / greatest(compress_size, 1) > 100
                 THEN 'payload_too_large|extraction quota' END AS fault
          FROM (SELECT *, count(*) OVER (PARTITION BY archive_id) AS n_entries,
                  sum(file_size) OVER (PARTITION BY archive_id ORDER BY entry_no) AS declared,
                  row_number() OVER (PARTITION BY archive_id, lower(array_to_string(parts, '/'))
                                     ORDER BY entry_no) AS nth
                FROM member_paths))
    GROUP BY archive_id, n_entries"""


@register(f"""
    SELECT archive_id, n_entries, split_part(fault, '|', 1) AS code,
           split_part(fault, '|', 2) AS message, first_bad_entry
    FROM ({ADMISSION})""")
def admit_archives(spark, d):
    return A.admit_archives(I.archive_members(spark, d), **I.ARCHIVE_LIMITS)


def _screened(spark, d):
    return A.filter_source_files(I.source_files(spark, d), I.FILE_LIMIT)


@register("SELECT archive_id, path, why AS ignore_reason FROM screened")
def filter_source_files(spark, d):
    return _screened(spark, d).select("archive_id", "path", "ignore_reason")


@register("""
    SELECT archive_id, path, language, evidence, byte_size, line_count::BIGINT AS line_count,
           ignore_reason FROM detected""")
def detect_language(spark, d):
    return A.detect_language(_screened(spark, d)).drop("content")


@register("""
    SELECT archive_id,
           coalesce(array_to_string(list_sort(list(DISTINCT language)
             FILTER (WHERE ignore_reason IS NULL)), ','), '') AS languages,
           count(*) FILTER (WHERE ignore_reason IS NULL AND evidence = 'manifest')
             AS manifest_count,
           count(*) FILTER (WHERE ignore_reason IS NOT NULL) AS ignored_path_count,
           coalesce(sum(byte_size) FILTER (WHERE ignore_reason IS NULL), 0)::BIGINT AS byte_size,
           count(*) FILTER (WHERE ignore_reason IS NULL) AS file_count
    FROM detected GROUP BY archive_id""")
def inventory_summary(spark, d):
    summary = A.inventory_summary(A.detect_language(_screened(spark, d)))
    return summary.withColumn("languages", F.array_join("languages", ","))


@register("""
    SELECT archive_id, path, language FROM detected
    WHERE ignore_reason IS NULL AND evidence = 'manifest'""")
def manifest_paths(spark, d):
    return A.manifest_paths(A.detect_language(_screened(spark, d)))


@register(f"""
    WITH bad AS (SELECT archive_id::VARCHAR AS archive_id FROM ({ADMISSION})
                 WHERE fault IS NOT NULL),
         kept AS (SELECT d.* FROM detected d JOIN documents b
                    ON d.path LIKE 'p' || b.doc_id || '/%' AND b.source = d.archive_id
                  WHERE b.doc_id::VARCHAR NOT IN (FROM bad))
    SELECT split_part(substr(path, 2), '/', 1) AS archive_id,
           count(*) FILTER (WHERE ignore_reason IS NULL) AS file_count,
           coalesce(sum(line_count), 0)::BIGINT AS line_count
    FROM kept GROUP BY 1""")
def build_inventory(spark, d):
    """Each document as the one file of an archive, admitted by the members of an order."""
    files = I.source_files(spark, d).withColumn(
        "archive_id", F.regexp_extract("path", "^p([0-9]+)/", 1)
    )
    built = plan.build_inventory(
        I.archive_members(spark, d), files, I.ARCHIVE_LIMITS, I.FILE_LIMIT
    )
    lines = built.files.select("archive_id", "line_count")
    return (
        built.summary.select("archive_id", "file_count")
        .join(lines, "archive_id", "left")
        .select(
            "archive_id",
            "file_count",
            F.coalesce("line_count", F.lit(0)).cast("bigint").alias("line_count"),
        )
    )
