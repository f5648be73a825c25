"""Code graphs: normalisation, classification, resolution, deduplication and audits.

``raw_nodes`` and ``raw_edges`` are tables keyed by ``graph_id``. One graph may hold a large
share of all rows, so nothing here gathers a graph: counts and flags are aggregates with a
map-side combine and positions come from segmented scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import ids, text
from quire.operators.layout import literal_map
from quire.operators.scan import position_in_unit
from quire.rejects import Code, drop_units, first_failure, reject_rows, union_rejects
from quire.session import materialize

# Provenance tags, parser evidence, relation names, reasons and warnings.
PROVENANCE = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
PARSER = "graphify"
NODE_RULE = "structural_entity"
RELATION_NAMES = {"method": "declares", "imports_from": "imports"}
UNRESOLVED_REASON = "unresolved_source_location_or_confidence"
AMBIGUOUS_REASON = "graphify_ambiguous_relationship"
WARN_PARTIAL = "graphify_partial_parse_failure"
WARN_EMPTY = "no_structural_entities"
WARN_AMBIGUOUS = "unresolved_entities"
WARN_ENDPOINT = "unresolved_edge_endpoint"
#: Hashes of repeated ids up to which they are broadcast to the edges; above, both are shuffled.
BROADCAST_KEYS = 2_000_000


def _line(digits: Column) -> Column:
    """A line number in digits of any script; one too large for an INT is past the end of any file."""
    return F.coalesce(text.decimal_digits(digits).try_cast("int"), F.lit(2**31 - 1))


def normalize_graph_element(elements: DataFrame, rule: Column) -> DataFrame:
    """Location, provenance, confidence, reason and rule of raw nodes or edges."""
    path = F.regexp_replace(F.coalesce("source_file", F.lit("")), r"^/source/", "")
    at = F.coalesce("source_location", F.lit(""))
    pattern = rf"\AL({text.DIGIT}+)(?:[-–]L?({text.DIGIT}+))?\z"
    start = F.regexp_extract(at, pattern, 1)
    end = F.regexp_extract(at, pattern, 2)
    last = F.when(end != "", end).otherwise(start)
    location = F.when(
        (path != "") & (start != ""),
        F.struct(
            path.alias("path"),
            _line(start).alias("start_line"),
            _line(last).alias("end_line"),
        ),
    )
    tag = F.coalesce("confidence", F.lit("EXTRACTED"))
    score = F.coalesce(
        F.col("confidence_score").cast("double"), F.when(tag == "EXTRACTED", F.lit(1.0))
    )
    unresolved = F.col("location").isNull() | ((tag == "INFERRED") & score.isNull())
    return elements.withColumn("location", location).withColumns(
        {
            "provenance": F.when(unresolved & tag.isin(*PROVENANCE), "AMBIGUOUS").otherwise(tag),
            "confidence": F.when(~unresolved, score),
            "reason": F.when(unresolved, UNRESOLVED_REASON).when(
                tag == "AMBIGUOUS", AMBIGUOUS_REASON
            ),
            "rule": rule,
        }
    )


def classify_node(raw_nodes: DataFrame, raw_edges: DataFrame) -> DataFrame:
    """``kind``: a declared type, else class, method, function, module or plain entity."""
    methods = (
        raw_edges.filter(F.col("relation") == "method")
        .select("graph_id", F.col("target").alias("id"), F.lit(True).alias("_is_method"))
        .distinct()
    )

    def filled(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name))

    declared = F.coalesce(filled("type"), filled("metadata_kind"), filled("metadata_type"))
    kind = (
        F.when(F.coalesce(declared, F.lit("entity")) != "entity", declared)
        .when(F.col("callable_class"), "class")
        .when(F.col("_is_method"), "method")
        .when(F.col("callable"), "function")
        .when(
            F.col("label") == text.base_name(F.coalesce("source_file", F.lit(""))), "module"
        )
        .otherwise("entity")
    )
    return (
        raw_nodes.join(methods, ["graph_id", "id"], "left")
        .withColumn("kind", kind)
        .drop("_is_method")
    )


def normalize_relation(edges: DataFrame) -> DataFrame:
    mapped = literal_map(RELATION_NAMES)[F.col("relation")]
    return edges.withColumn("rule", F.col("relation")).withColumn(
        "relation", F.coalesce(mapped, F.col("relation"))
    )


def normalize_nodes(raw_nodes: DataFrame, raw_edges: DataFrame) -> DataFrame:
    """Classified nodes with stable ids; ``raw_id`` keeps the parser's own id."""
    classified = classify_node(raw_nodes, raw_edges)
    return normalize_graph_element(classified, F.lit(NODE_RULE)).select(
        "graph_id",
        ids.node_id(F.col("id"), F.col("source_file"), F.col("source_location")).alias("id"),
        F.col("id").alias("raw_id"),
        "kind",
        F.coalesce(F.col("label"), F.col("id").cast("string")).alias("name"),
        "location",
        "provenance",
        "confidence",
        "reason",
        "rule",
    )


def match_edges(raw_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All edges, ``resolved`` if both their ends exist; those carry node ids as ends. Ids travel packed."""
    ends = nodes.select("graph_id", F.col("raw_id"), ids.packed(F.col("id")).alias("_id")).distinct()
    sources = ends.select("graph_id", F.col("raw_id").alias("source"), F.col("_id").alias("_from"))
    targets = ends.select("graph_id", F.col("raw_id").alias("target"), F.col("_id").alias("_to"))
    joined = raw_edges.join(sources, ["graph_id", "source"], "left").join(
        targets, ["graph_id", "target"], "left"
    )
    found = F.col("_from").isNotNull() & F.col("_to").isNotNull()
    return joined.select(
        *(
            F.when(found, ids.unpacked(F.col(end))).otherwise(F.col(name)).alias(name)
            if (end := {"source": "_from", "target": "_to"}.get(name))
            else F.col(name)
            for name in joined.columns
            if name not in ("_from", "_to")
        ),
        found.alias("resolved"),
    )


def resolve_edges(raw_edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose both ends exist, carrying node ids; and the ones left unresolved."""
    matched = match_edges(raw_edges, nodes)
    return matched.filter("resolved").drop("resolved"), matched.filter("not resolved").drop("resolved")


def normalize_edges(resolved: DataFrame) -> DataFrame:
    """Named relations, evidence and stable ids for edges that carry node ids as ends."""
    named = normalize_relation(resolved)
    return normalize_graph_element(named, F.col("rule")).select(
        "graph_id",
        ids.edge_id(
            F.col("source"),
            F.col("target"),
            F.col("relation"),
            F.col("source_location"),
            F.col("source_file"),
        ).alias("id"),
        "source",
        "target",
        "relation",
        "location",
        "provenance",
        "confidence",
        "reason",
        "rule",
        *(c for c in resolved.columns if c == "resolved"),
    )


def audit_raw_elements(raw_nodes: DataFrame, raw_edges: DataFrame) -> DataFrame:
    """Graphs with a node without an id, or an edge without an end or a relation."""
    missing = raw_nodes.filter("id IS NULL").select("graph_id", F.lit("node without id").alias("why"))
    loose = raw_edges.filter("source IS NULL OR target IS NULL OR relation IS NULL").select(
        "graph_id", F.lit("edge without ends or relation").alias("why")
    )
    return reject_rows(
        missing.unionByName(loose).distinct(),
        "graph_id",
        Code.PARSER_ERROR,
        F.col("why"),
        F.lit(None).cast("string"),
    )


def audit_duplicate_ids(df: DataFrame, unit: str, keys: list[str], what: str) -> DataFrame:
    """Ids that occur more than once in their unit."""
    repeated = df.groupBy(unit, *keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return reject_rows(
        repeated,
        unit,
        Code.PARSER_ERROR,
        f"duplicate {what}",
        F.concat_ws("/", *(F.col(k).cast("string") for k in keys)),
    )


def edge_content(edges: DataFrame) -> Column:
    """What has to be equal for two edges with one id to be the same edge."""
    return ids.digest(
        F.col("provenance").alias("provenance"),
        F.col("confidence").cast("string").alias("confidence"),
        F.col("reason").alias("reason"),
        F.col("rule").alias("rule"),
        F.col("location").alias("location"),
    )


def dedupe_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal edges collapse to one; one id with differing content voids the graph.

    64-bit hashes of the ids, moved alone, find what may repeat. Only edges of such ids are moved: their ids and
    contents are compared as they are. All others stay where they lie, as long as the hashes can be broadcast.
    """
    keyed = edges.withColumn("_key", F.xxhash64("graph_id", "id"))
    often = materialize(keyed.groupBy("_key").count().where("count > 1").select("_key"))
    small = often.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    again = F.broadcast(often) if small else often
    repeated = materialize(keyed.join(again, "_key", "left_semi").drop("_key"))
    content = repeated.select("graph_id", "id", edge_content(repeated).alias("_content"))
    differing = content.groupBy("graph_id", "id").agg(
        (F.min("_content") != F.max("_content")).alias("differ")
    ).filter("differ")
    conflicts = materialize(differing.groupBy("graph_id").agg(F.min("id").alias("edge")))
    rejects = reject_rows(
        conflicts, "graph_id", Code.PARSER_ERROR, "conflicting edge evidence", F.col("edge")
    )
    left = materialize(drop_units(repeated, rejects, "graph_id").dropDuplicates(["graph_id", "id"]))
    once = drop_units(keyed.join(again, "_key", "left_anti").drop("_key"), rejects, "graph_id")
    unique = once.unionByName(left)
    return unique if small else materialize(unique), rejects


def graph_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges in the columns they share, plus the name each must have."""
    common = ["graph_id", "id", "location", "provenance", "confidence", "reason", "rule"]
    return nodes.select(
        *common, F.lit("node").alias("element"), F.col("kind").alias("called")
    ).unionByName(
        edges.select(*common, F.lit("edge").alias("element"), F.col("relation").alias("called"))
    )


def audit_graph_elements(elements: DataFrame, parser: str, version: str) -> DataFrame:
    """Elements whose evidence does not support their provenance tag."""
    blank = (F.coalesce(F.lit(parser), F.lit("")) == "") | (F.lit(version) == "")
    message = first_failure(
        (~F.coalesce(F.col("provenance").isin(*PROVENANCE), F.lit(False)), "unknown provenance"),
        (F.coalesce(F.col("id"), F.lit("")) == "", "empty id"),
        (
            ~F.coalesce(F.col("confidence").between(0, 1), F.lit(True)),
            "confidence out of range",
        ),
        (F.coalesce(F.col("called"), F.lit("")) == "", "empty kind or relation"),
        (blank | (F.coalesce(F.col("rule"), F.lit("")) == ""), "missing parser evidence"),
        (
            (F.col("provenance") == "EXTRACTED") & F.col("location").isNull(),
            "extracted element without source span",
        ),
        (
            (F.col("provenance") == "INFERRED") & F.col("confidence").isNull(),
            "inferred element without confidence",
        ),
        (
            (F.col("provenance") == "AMBIGUOUS")
            & (F.coalesce(F.col("reason"), F.lit("")) == ""),
            "ambiguous element without reason",
        ),
    )
    failing = elements.withColumn("_message", message).filter(F.col("_message").isNotNull())
    return reject_rows(failing, "graph_id", Code.PARSER_ERROR, F.col("_message"), F.col("id"))


def audit_graph_locations(elements: DataFrame, inventory: DataFrame) -> DataFrame:
    """Located paths that are malformed, missing from the inventory, or overrun the file.

    Elements are first reduced to one row per (graph, path), so a file mentioned by a large
    share of all elements is one row when it meets the inventory.
    """
    path = F.col("location.path")
    malformed = (
        (F.col("location.start_line") <= 0)
        | (F.col("location.end_line") < F.col("location.start_line"))
        | path.startswith("/")
        | path.rlike(r"[\\:\x00]")
        | F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))
    )
    reached = (
        elements.filter(F.col("location").isNotNull())
        .groupBy("graph_id", path.alias("path"))
        .agg(
            F.max("location.end_line").alias("_last"),
            F.max(malformed.cast("int")).alias("_malformed"),
        )
    )
    message = first_failure(
        (F.col("_malformed") == 1, "malformed location"),
        (F.col("line_count").isNull(), "path outside inventory"),
        (F.col("_last") > F.col("line_count"), "line outside file"),
    )
    failing = (
        reached.join(
            inventory.select("graph_id", "path", "line_count"), ["graph_id", "path"], "left"
        )
        .withColumn("_message", message)
        .filter(F.col("_message").isNotNull())
    )
    return reject_rows(failing, "graph_id", Code.PARSER_ERROR, F.col("_message"), F.col("path"))


def audit_edge_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edge ends that are no node of their graph."""
    ends = edges.select(
        "graph_id", F.explode(F.array("source", "target")).alias("id")
    ).distinct()
    unknown = ends.join(nodes.select("graph_id", "id"), ["graph_id", "id"], "left_anti")
    return reject_rows(
        unknown, "graph_id", Code.PARSER_ERROR, "unknown edge endpoint", F.col("id")
    )


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges per graph, over graphs that have any."""
    marked = nodes.select("graph_id", F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(
        edges.select("graph_id", F.lit(0).alias("n"), F.lit(1).alias("e"))
    )
    return marked.groupBy("graph_id").agg(
        F.sum("n").alias("node_count"), F.sum("e").alias("edge_count")
    )


def provenance_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes plus edges by provenance, one row per (graph, provenance)."""
    return (
        nodes.select("graph_id", "provenance")
        .unionByName(edges.select("graph_id", "provenance"))
        .groupBy("graph_id", "provenance")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def provenance_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same counts as one map per graph, of at most three entries."""
    pairs = F.sort_array(F.collect_list(F.struct("provenance", "n")))
    return (
        provenance_counts(nodes, edges)
        .groupBy("graph_id")
        .agg(F.map_from_entries(pairs).alias("provenance_summary"))
    )


def graph_warnings(
    graphs: DataFrame, nodes: DataFrame, edges: DataFrame, unresolved: DataFrame
) -> DataFrame:
    """Sorted warnings and status of every graph. ``edges`` are those before deduplication."""
    seen = (
        nodes.select(
            "graph_id",
            F.lit(1).alias("node"),
            (F.col("provenance") == "AMBIGUOUS").cast("int").alias("ambiguous"),
            F.lit(0).alias("loose"),
        )
        .unionByName(
            edges.select(
                "graph_id",
                F.lit(0).alias("node"),
                (F.col("provenance") == "AMBIGUOUS").cast("int").alias("ambiguous"),
                F.lit(0).alias("loose"),
            )
        )
        .unionByName(
            unresolved.select(
                "graph_id",
                F.lit(0).alias("node"),
                F.lit(0).alias("ambiguous"),
                F.lit(1).alias("loose"),
            )
        )
        .groupBy("graph_id")
        .agg(F.max("node").alias("n"), F.max("ambiguous").alias("a"), F.max("loose").alias("l"))
    )
    warnings = F.sort_array(
        F.array_compact(
            F.array(
                F.when(F.col("parse_failed"), WARN_PARTIAL),
                F.when(F.coalesce("n", F.lit(0)) == 0, WARN_EMPTY),
                F.when(F.col("a") == 1, WARN_AMBIGUOUS),
                F.when(F.col("l") == 1, WARN_ENDPOINT),
            )
        )
    )
    return (
        graphs.select("graph_id", "parse_failed")
        .join(seen, "graph_id", "left")
        .select("graph_id", warnings.alias("warnings"))
        .withColumn("status", F.when(F.size("warnings") > 0, "partial").otherwise("complete"))
    )


def canonical_node_order(nodes: DataFrame, segments: int | None = None) -> DataFrame:
    """``position`` of nodes by id, for their keys alone."""
    keys = nodes.select("graph_id", "id")
    return position_in_unit(keys, ["graph_id"], ["id"], segments=segments)


def canonical_edge_order(edges: DataFrame, segments: int | None = None) -> DataFrame:
    """``position`` of edges by (source, relation, target, id), for their keys alone."""
    order = ["source", "relation", "target", "id"]
    return position_in_unit(
        edges.select("graph_id", *order), ["graph_id"], order, segments=segments
    )


def reject_graphs(
    nodes: DataFrame, edges: DataFrame, *audits: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Void every graph an audit names."""
    rejects = union_rejects(*audits)
    return drop_units(nodes, rejects, "graph_id"), drop_units(edges, rejects, "graph_id"), rejects
