"""Code graph, archive and source file operators on literal rows."""

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import archives as A
from quire.operators import code_graph as G
from quire.sources import sinks
from quire.sources.graph_json import read_code_graph

RAW_NODE = (
    "graph_id INT, id STRING, label STRING, source_file STRING, source_location STRING,"
    " confidence STRING, confidence_score DOUBLE, type STRING, metadata_kind STRING,"
    " metadata_type STRING, callable_class BOOLEAN, callable BOOLEAN"
)


def raw(spark, *rows):
    names = RAW_NODE.replace(",", "").split()[::2]
    full = [
        tuple({"graph_id": 1, "id": str(i), "callable": False, "callable_class": False, **r}.get(n)
              for n in names)
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, RAW_NODE)


def test_locations_and_provenance(spark):
    rows = [
        ({"source_file": "/source/a.py", "source_location": "L3"}, ("a.py", 3, 3, "EXTRACTED", 1.0)),
        ({"source_file": "a.py", "source_location": "L3-L9"}, ("a.py", 3, 9, "EXTRACTED", 1.0)),
        ({"source_file": "a.py", "source_location": "L3–9"}, ("a.py", 3, 9, "EXTRACTED", 1.0)),
        ({"source_file": "a.py", "source_location": "L3-L9x"}, (None, None, None, "AMBIGUOUS", None)),
        ({"source_file": "a.py"}, (None, None, None, "AMBIGUOUS", None)),
        ({"source_location": "L1"}, (None, None, None, "AMBIGUOUS", None)),
        ({"source_file": "a.py", "source_location": "L1", "confidence": "INFERRED"},
         (None, None, None, "AMBIGUOUS", None)),
        ({"source_file": "a.py", "source_location": "L1", "confidence": "INFERRED",
          "confidence_score": 0.4}, ("a.py", 1, 1, "INFERRED", 0.4)),
        ({"source_file": "a.py", "source_location": "L1", "confidence": "AMBIGUOUS",
          "confidence_score": 0.2}, ("a.py", 1, 1, "AMBIGUOUS", 0.2)),
    ]
    out = G.normalize_graph_element(raw(spark, *(r for r, _ in rows)), F.lit(G.NODE_RULE))
    got = {int(r.id): r for r in out.collect()}
    for i, (given, want) in enumerate(rows):
        r = got[i]
        place = tuple(r.location) if r.location else (None, None, None)
        if given.get("confidence") == "INFERRED" and want[3] == "AMBIGUOUS":
            place = (None, None, None)
        assert (*place, r.provenance, r.confidence) == want
    assert got[4].reason == G.UNRESOLVED_REASON
    assert got[8].reason == G.AMBIGUOUS_REASON and got[7].reason is None


def test_line_digits_of_any_script_and_unknown_tags(spark):
    rows = [
        {"source_file": "a.py", "source_location": "L٣-L１２"},
        {"source_file": "a.py", "source_location": "L99999999999"},
        {"confidence": "GUESSED"},
    ]
    out = G.normalize_graph_element(raw(spark, *rows), F.lit(G.NODE_RULE)).collect()
    got = {int(r.id): r for r in out}
    assert tuple(got[0].location) == ("a.py", 3, 12)
    assert got[1].location.start_line == 2**31 - 1
    assert got[2].provenance == "GUESSED"


def test_raw_elements_without_ids(spark):
    nodes = raw(spark, {"graph_id": 1}, {"graph_id": 2, "id": None})
    edges = spark.createDataFrame(
        [(1, "0", "0", "calls"), (3, None, "0", "calls"), (4, "0", "0", None)],
        "graph_id INT, source STRING, target STRING, relation STRING",
    )
    assert {r.unit_id for r in G.audit_raw_elements(nodes, edges).collect()} == {"2", "3", "4"}


def test_confidence_is_compared_exactly(spark):
    rows = [(1, "e", "a", "b", "r", None, "EXTRACTED", c, None, "r") for c in (0.1234561, 0.1234564)]
    edges = spark.createDataFrame(
        rows,
        "graph_id INT, id STRING, source STRING, target STRING, relation STRING,"
        " location STRUCT<path: STRING, start_line: INT, end_line: INT>, provenance STRING,"
        " confidence DOUBLE, reason STRING, rule STRING",
    )
    kept, rejects = G.dedupe_edges(edges)
    assert kept.isEmpty() and [r.message for r in rejects.collect()] == ["conflicting edge evidence"]


def test_documents_of_any_size_are_written_in_parts(spark, tmp_path):
    n = 200_000
    nodes = spark.range(n).select(
        F.lit(1).alias("graph_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("id"),
        F.lit("entity").alias("kind"),
        F.concat(F.lit("name " * 20), "id").alias("name"),
        F.expr("named_struct('path', 'a.py', 'start_line', 1, 'end_line', 2)").alias("location"),
        F.lit("EXTRACTED").alias("provenance"),
        (F.lit(1.0) / (F.col("id") + 1)).alias("confidence"),
        F.lit(None).cast("string").alias("reason"),
        F.lit(G.NODE_RULE).alias("rule"),
    )
    edges = nodes.limit(0).select(
        "graph_id", "id", F.lit("").alias("source"), F.lit("").alias("target"),
        F.lit("").alias("relation"), "location", "provenance", "confidence", "reason", "rule",
    )
    files = spark.createDataFrame([(1, "a.py", 9)], "graph_id INT, path STRING, line_count INT")
    warnings = spark.createDataFrame([(1, [], "complete")], "graph_id INT, warnings ARRAY<STRING>, status STRING")
    sources = spark.createDataFrame([(1, "s", "h")], "graph_id INT, source_artifact_id STRING, source_sha256 STRING")
    parts = sinks.graph_parts(nodes, edges, files).cache()
    document = sinks.graph_documents(nodes, edges, parts, warnings, sources, "1")
    row = document.first()
    assert row.graph_byte_size > 32 * 1024 * 1024 and row.node_count == n
    assert parts.count() == -(-n // sinks.PART_ROWS) + 1
    sinks.write_graph_document(document, parts, str(tmp_path))
    read = sinks.read_graph_elements(spark, str(tmp_path), "nodes", "id STRING, confidence DOUBLE")
    want = nodes.select("id", "confidence")
    assert read.select("element.id", "element.confidence").exceptAll(want).isEmpty()
    ids = [r.id for r in read.orderBy("position").select("element.id").collect()]
    assert ids == sorted(ids) and len(ids) == n
    text = json.loads("[" + parts.filter("part = 'nodes'").orderBy("part_no").first().json + "]")
    assert text[0]["id"] == ids[0]


def test_node_kinds(spark):
    rows = [
        ({"type": "struct"}, "struct"), ({"type": "", "metadata_kind": "enum"}, "enum"),
        ({"metadata_type": "trait", "callable": True}, "trait"),
        ({"callable_class": True, "callable": True}, "class"), ({"callable": True}, "method"),
        ({"callable": True}, "function"), ({"label": "a.py", "source_file": "x/a.py"}, "module"),
        ({"label": "b", "source_file": "x/a.py"}, "entity"), ({"type": "entity"}, "entity"),
    ]
    edges = spark.createDataFrame(
        [(1, "0", "4", "method"), (1, "1", "4", "method"), (1, "0", "5", "calls"),
         (2, "0", "5", "method")],
        "graph_id INT, source STRING, target STRING, relation STRING",
    )
    out = G.classify_node(raw(spark, *(r for r, _ in rows)), edges)
    assert [r.kind for r in out.orderBy("id").collect()] == [k for _, k in rows]


def test_duplicate_edges_collapse_or_conflict(spark):
    rows = [
        (1, "e", "EXTRACTED", 1.0), (1, "e", "EXTRACTED", 1.0), (1, "f", "INFERRED", 0.5),
        (2, "e", "EXTRACTED", 1.0), (2, "e", "INFERRED", 1.0), (3, "e", "AMBIGUOUS", None),
        (3, "e", "AMBIGUOUS", None),
    ]
    edges = spark.createDataFrame(rows, "graph_id INT, id STRING, provenance STRING,"
                                  " confidence DOUBLE").selectExpr(
        "*", "'s' AS source", "'t' AS target", "'calls' AS relation", "'calls' AS rule",
        "CAST(NULL AS STRING) AS reason",
        "named_struct('path', 'a', 'start_line', 1, 'end_line', 2) AS location",
    )
    unique, rejects = G.dedupe_edges(edges)
    assert sorted((r.graph_id, r.id) for r in unique.collect()) == [(1, "e"), (1, "f"), (3, "e")]
    assert [(r.unit_id, r.offender) for r in rejects.collect()] == [("2", "e")]


def test_edge_order_with_a_hot_source(spark):
    rows = [(i % 3 // 2, "hot" if i % 3 else f"s{i % 7}", "calls" if i % 2 else "uses",
             f"t{i % 5}", f"{i:04d}") for i in range(600)]
    edges = spark.createDataFrame(rows, "graph_id INT, source STRING, relation STRING,"
                                  " target STRING, id STRING")
    w = Window.partitionBy("graph_id").orderBy("source", "relation", "target", "id")
    expected = edges.withColumn("position", F.row_number().over(w).cast("bigint"))
    actual = G.canonical_edge_order(edges, segments=12).select(*expected.columns)
    assert sorted(actual.collect()) == sorted(expected.collect())


def test_element_and_location_audits(spark):
    rows = [
        ("ok", "a.py", 1, 2, "EXTRACTED", 1.0, None, None),
        ("range", "a.py", 1, 2, "EXTRACTED", 1.5, None, "confidence out of range"),
        ("nospan", None, None, None, "EXTRACTED", 1.0, None, "extracted element without source span"),
        ("noscore", "a.py", 1, 2, "INFERRED", None, None, "inferred element without confidence"),
        ("noreason", "a.py", 1, 2, "AMBIGUOUS", None, None, "ambiguous element without reason"),
        ("tag", "a.py", 1, 2, "GUESSED", None, None, "unknown provenance"),
    ]
    elements = spark.createDataFrame(
        [r[:7] for r in rows], "id STRING, path STRING, a INT, b INT, provenance STRING,"
        " confidence DOUBLE, reason STRING",
    ).selectExpr(
        "1 AS graph_id", "id", "provenance", "confidence", "reason", "'r' AS rule",
        "'node' AS element", "'k' AS called",
        "IF(path IS NULL, NULL, named_struct('path', path, 'start_line', a, 'end_line', b))"
        " AS location",
    )
    got = {r.offender: r.message for r in G.audit_graph_elements(elements, "p", "1").collect()}
    assert got == {r[0]: r[7] for r in rows if r[7]}
    assert G.audit_graph_elements(elements, "p", "").count() == 6

    places = [("a.py", 1, 9), ("a.py", 1, 11), ("b.py", 1, 1), ("/c.py", 1, 1), ("d//e", 1, 1),
              ("x:y", 1, 1), ("../z", 1, 1), ("f.py", 0, 1), ("g.py", 3, 2)]
    located = spark.createDataFrame(places, "path STRING, a INT, b INT").selectExpr(
        "1 AS graph_id", "path AS id",
        "named_struct('path', path, 'start_line', a, 'end_line', b) AS location",
    )
    files = spark.createDataFrame([(1, p, 10) for p in ("a.py", "f.py", "g.py")],
                                  "graph_id INT, path STRING, line_count INT")
    got = {r.offender: r.message for r in G.audit_graph_locations(located, files).collect()}
    assert got.pop("a.py") == "line outside file" and got.pop("b.py") == "path outside inventory"
    assert set(got.values()) == {"malformed location"} and len(got) == 6


def test_graph_documents_and_flags(spark):
    base = {"nodes": [], "edges": []}
    cases = [
        ({**base}, False), ({**base, "errors": []}, False), ({**base, "errors": ["x"]}, True),
        ({**base, "error": ""}, False), ({**base, "error": "0"}, True), ({**base, "error": 0}, False),
        ({**base, "failed_sources": {}}, False), ({**base, "failed_sources": {"a": 1}}, True),
        ({**base, "worker_warnings": 2.5}, True), ({**base, "error": None}, False),
        ({**base, "error": False}, False), ({**base, "error": True}, True),
    ]
    documents = spark.createDataFrame(
        [(i, json.dumps(doc)) for i, (doc, _) in enumerate(cases)], "graph_id INT, json STRING"
    )
    _, _, graphs, rejects = read_code_graph(documents)
    assert {r.graph_id: r.parse_failed for r in graphs.collect()} == {
        i: flag for i, (_, flag) in enumerate(cases)
    }
    assert rejects.isEmpty()
    broken = spark.createDataFrame(
        [(1, "{"), (2, '{"nodes": []}'), (3, '{"nodes": 5, "edges": []}'), (4, json.dumps(base))],
        "graph_id INT, json STRING",
    )
    assert {r.unit_id for r in read_code_graph(broken)[3].collect()} == {"1", "2", "3"}
    assert {r.message for r in read_code_graph(broken, max_bytes=3)[3].collect()} == {
        "output exceeds quota", "no lists of nodes and edges"
    }


def test_member_paths(spark):
    names = {
        "a/b.py": False, "a\\b.py": False, "dir/": False, "": True, "/": True, "/a": True,
        "a//b": True, "./a": True, "a/..": True, "a /b": True, "a./b": True, "con": True,
        "x/CON.txt": True, "x/Com1.a.b": True, "com10": False, "lpt9": True, "a:b": True,
        "a\x01b": True, "a?": True, "console.py": False, "\\a": True, "nul.": True,
    }
    df = spark.createDataFrame([(n,) for n in names], "name STRING")
    got = {r.name: r.unsafe for r in A.validate_member_path(df).collect()}
    assert got == names


def members(spark, archives):
    rows = [
        (a, i + 1, *entry) for a, entries in archives.items() for i, entry in enumerate(entries)
    ]
    return spark.createDataFrame(
        rows, "archive_id STRING, entry_no BIGINT, name STRING, file_size BIGINT,"
        " compress_size BIGINT, mode STRING",
    )


def test_archive_admission_takes_the_first_fault(spark):
    def e(name="a.py", size=10, packed=10, mode="regular"):
        return (name, size, packed, mode)

    archives = {
        "ok": [e(), e("b/", 0, 0, "directory"), e("c", 1, 1, "none")],
        "many": [e(f"f{i}") for i in range(6)],
        "many_unsafe": [e("../x")] + [e(f"f{i}") for i in range(6)],
        "unsafe": [e(), e("../x"), e("A.PY")],
        "twin": [e(), e("Straße"), e("STRASSE"), e("../x")],
        "link": [e(mode="symlink")],
        "big": [e("x", 101, 101)],
        "total": [e("a", 90, 90), e("b", 90, 90), e("c", 90, 90)],
        "ratio": [e("a", 90, 1), e("b", 90, 0)],
        "deep": [e("a/b/c/d")],
        "quota_first": [e("x", 101, 101), e("../x")],
    }
    got = {
        r.archive_id: (r.code, r.first_bad_entry)
        for r in A.admit_archives(
            members(spark, archives), max_entries=5, max_total=200, max_file=100, max_depth=3,
            max_ratio=50,
        ).collect()
    }
    assert got == {
        "ok": (None, None), "many": ("payload_too_large", None),
        "many_unsafe": ("payload_too_large", None), "unsafe": ("bad_request", 2),
        "twin": ("bad_request", 3), "link": ("bad_request", 1), "big": ("payload_too_large", 1),
        "total": ("payload_too_large", 3), "ratio": ("payload_too_large", 1),
        "deep": ("payload_too_large", 1), "quota_first": ("payload_too_large", 1),
    }


def test_sparse_entry_numbers_are_checked(spark):
    rows = [("a", 1, "x.py"), ("a", 20_000, "../evil.py"), ("b", 20_000, "y.py")]
    df = spark.createDataFrame(
        [(*r, 1, 1, "regular") for r in rows],
        "archive_id STRING, entry_no BIGINT, name STRING, file_size BIGINT, compress_size BIGINT, mode STRING",
    )
    got = {r.archive_id: (r.message, r.first_bad_entry) for r in A.admit_archives(df).collect()}
    assert got == {"a": ("unsafe path", 20_000), "b": (None, None)}


def test_files_languages_and_lines(spark):
    files = {
        "a.py": (b"x\ny", None, "python", "extension", 2),
        "A.PY": (b"", None, "python", "extension", 1),
        "x/build": (b"x", "ignored_path", None, None, None),
        "Build/a.py": (b"x", "ignored_path", None, None, None),
        "x.min.js": (b"x", "generated", None, None, None),
        "X.MIN.JS": (b"x", None, "javascript", "extension", 1),
        ".env": (b"x", "environment", None, None, None),
        ".env.py": (b"x", "environment", None, None, None),
        ".environment": (b"x", "no_language", None, None, None),
        "bad.py": (b"\xff\xfe", "not_utf8", None, None, None),
        "nul.py": (b"a\x00b", "binary", None, None, None),
        "big.py": (b"x" * 100, "too_large", None, None, None),
        "package.json": (b"{}\n", None, "javascript", "manifest", 1),
        "Package.json": (b"{}", "no_language", None, None, None),
        "cargo.toml": (b"", "no_language", None, None, None),
        "Cargo.toml": (b"", None, "rust", "manifest", 1),
        "run": (b"#!/usr/bin/env node python\nx\n", None, "python", "shebang", 2),
        "run2": (b"#!/bin/ruby", None, "ruby", "shebang", 1),
        "run3": (b"#!/bin/sh\npython", "no_language", None, None, None),
        "bom": (b"\xef\xbb\xbf#!/bin/python\n", None, "python", "shebang", 1),
        "run.": (b"#!/bin/python\n", None, "python", "shebang", 1),
        "t.go": ("a\r\nb\rc\vd\fe\x1cf\x85g h ".encode(), None, "go", "extension", 8),
    }
    df = spark.createDataFrame(
        [("z", p, bytearray(f[0])) for p, f in files.items()],
        "archive_id STRING, path STRING, content BINARY",
    )
    detected = A.detect_language(A.filter_source_files(df, max_bytes=50))
    got = {r.path: (r.ignore_reason, r.language, r.evidence, r.line_count)
           for r in detected.collect()}
    assert got == {p: f[1:] for p, f in files.items()}
    summary = A.inventory_summary(detected).first()
    assert summary.languages == ["go", "javascript", "python", "ruby", "rust"]
    assert (summary.manifest_count, summary.file_count) == (2, 10)
    assert summary.ignored_path_count == len(files) - 10


def test_line_count_equals_splitlines(spark):
    texts = ["", "\n", "a", "a\n", "a\n\n", "\r\n", "a\r\nb", "\n\r", "\x1d\x1e", "a ", "a\tb"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for r in df.withColumn("n", text.line_count(F.col("t"))).collect():
        assert r.n == max(1, len(r.t.splitlines())), repr(r.t)
