"""What is moved and written: rows that need no move stay where they are."""

import os
import re

import pytest
from pyspark.sql import functions as F

from checks import graph_queries
from quire.functions import ids
from quire.operators import code_graph as G
from quire.operators.scan import position_in_unit
from quire.session import materialize
from quire.sources.sinks import graph_parts


def _plan(df):
    return df._jdf.queryExecution().toString()


def _edges(spark, n=1000):
    return spark.range(n).selectExpr(
        "id % 3 AS graph_id", "sha2(CAST(id % 990 AS STRING), 256) AS id", "sha2('s', 256) AS source",
        "sha2('t', 256) AS target", "'calls' AS relation", "'calls' AS rule", "'EXTRACTED' AS provenance",
        "1.0D AS confidence", "CAST(NULL AS STRING) AS reason",
        "named_struct('path', 'a', 'start_line', 1, 'end_line', 2) AS location",
    )


def test_edges_that_occur_once_are_not_moved(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        unique, rejects = G.dedupe_edges(materialize(_edges(spark)))
        assert unique.count() == 990 and rejects.isEmpty()
        assert "hashpartitioning(graph_id" not in _plan(unique)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_repeated_ids_give_the_same_edges(spark, monkeypatch):
    edges = materialize(_edges(spark))
    few = sorted(G.dedupe_edges(edges)[0].collect())
    monkeypatch.setattr(G, "BROADCAST_KEYS", 3)
    assert sorted(G.dedupe_edges(edges)[0].collect()) == few


def test_positions_need_one_move_of_the_rows(spark):
    rows = materialize(spark.range(5000).selectExpr("id % 2 AS unit", "sha2(CAST(id AS STRING), 256) AS at", "id AS v"))
    placed = position_in_unit(rows, ["unit"], ["at"], segments=16, keep=["unit", "v"])
    assert "Window" not in _plan(placed)  # rows are numbered where the ranges put them
    expected = [(u, r.v, i + 1) for u in (0, 1) for i, r in enumerate(rows.where(F.col("unit") == u).orderBy("at").collect())]
    assert sorted(map(tuple, placed.collect())) == sorted(expected)


def test_elements_of_long_lists_do_not_meet_their_numbers_in_a_join(spark):
    edges = materialize(_edges(spark, 980))
    files = spark.createDataFrame([(1, "a.py", 9)], "graph_id LONG, path STRING, line_count INT")
    nodes = edges.limit(0).selectExpr("graph_id", "id", "rule AS kind", "rule AS name", "location", "provenance", "confidence", "reason", "rule")
    parts = graph_parts(nodes, edges, files, rows=100)
    assert "at_0#" not in _plan(parts.where("part = 'edges' AND part_no > 0")).split("== Physical Plan ==")[1]
    listed = parts.where("part = 'edges' AND graph_id = 1").orderBy("part_no").collect()
    assert [r.part_no for r in listed] == [0, 1, 2, 3]
    found = [i for r in listed for i in spark.sql("SELECT from_json('[' || :j || ']', 'ARRAY<STRUCT<id: STRING>>').id AS i", {"j": r.json}).first().i]
    assert found == sorted(r.id for r in edges.where("graph_id = 1").collect())


def test_written_digests_take_half_their_length(spark):
    table = materialize(spark.range(20_000).selectExpr("sha2(CAST(id AS STRING), 256) AS id"))
    files = table.inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)
    assert sum(os.path.getsize(f.removeprefix("file://")) for f in files) < 40 * 20_000


def test_packed_ids_come_back(spark):
    some = ["a" * 64, "A" * 64, "", "x", "ab" * 31, "0f" * 32 + "\n", "\u00e9" * 16, "0" * 31, None]
    rows = spark.createDataFrame([(s,) for s in some], "id STRING").select("id", ids.packed(F.col("id")).alias("p"))
    back = rows.select("id", ids.unpacked(F.col("p")).alias("back"), F.octet_length("p").alias("n")).collect()
    assert all(r.back == r.id for r in back) and back[0].n == 33
    assert rows.select("p").where("p is not null").distinct().count() == len(some) - 1


def test_raw_edges_are_matched_once(spark, sf_dir, monkeypatch):
    calls, match = [], G.match_edges
    monkeypatch.setattr(G, "match_edges", lambda *a: calls.append(1) or match(*a))
    assert graph_queries._built(spark, sf_dir).documents.count() and len(calls) == 1


def test_pages_are_read_once(spark):
    """Pages that come from a costly job run it once, whatever the audits and the numbering read."""
    from pyspark.sql import types as T

    from quire.plans.report import audited_report_tables

    runs = spark.sparkContext.accumulator(0)

    def seen(json):
        runs.add(1)
        return json

    page = '{"parsing_res_list":[{"block_label":"doc_title","block_content":"%s [1]","block_bbox":[0,0,1,1]}]}'
    rows = [(a, 1, page % a) for a in "abc"] + [("d", 1, "{}"), ("e", None, None), ("a", 2, '{"parsing_res_list":[]}')]
    watched = F.udf(seen, T.StringType()).asNondeterministic()
    pages = spark.createDataFrame(rows, "artifact_id STRING, page_no INT, page_json STRING").withColumn(
        "page_json", watched("page_json")
    )
    built = audited_report_tables(pages)
    assert sorted(r.artifact_id for r in built.sections.collect()) == ["a", "b", "c"]
    assert sorted((r.unit_id, r.message) for r in built.rejects.collect()) == [("d", "invalid page blocks"), ("e", "no pages")]
    assert built.blocks.count() == 6 and runs.value == len(rows)


def test_blocks_move_without_their_ids(spark, sf_dir):
    from checks import inputs
    from quire.plans.report import build_report_tables
    from quire.sources.sinks import block_part, block_rows

    blocks = build_report_tables(inputs.layout_blocks(spark, sf_dir)).blocks
    part = block_part(blocks, "v")
    moved = part.derive(part.rows.hint("rebalance", F.col(part.unit)))
    dealt = moved._jdf.queryExecution().optimizedPlan().toString().split("RebalancePartitions")[1]
    assert "sha2(" not in dealt
    assert moved.exceptAll(block_rows(blocks, "v")).isEmpty()


def test_rejects_of_unpaired_submissions_sort_no_artifacts(spark):
    """which kinds there are is a hash aggregate; F13 to F15, F18: what is not kept does not travel."""
    from quire.operators import submissions as S

    rows = [(1, "report_pdf", 1, "a", "r1", "u", 1), (1, "report_pdf", 2, "b", "r2", "u", 1), (1, "report_pdf", 2, "c", "r3", "u", 1),
            (1, "source_archive", 1, "d", "s1", "u", 1), (2, "report_pdf", 1, "e", "r4", "u", 1), (3, None, 1, "f", "x", "u", 1)]
    artifacts = spark.createDataFrame(rows, "submission_id LONG, kind STRING, version_no INT, sha256 STRING, artifact_id STRING, object_uri STRING, byte_size LONG")
    submissions = spark.range(1, 5).selectExpr("id AS submission_id")
    ready, rejects = S.ready_submissions(submissions, artifacts, keep=[])
    assert "SortAggregate" not in _plan(rejects) and "object_uri" not in _plan(ready).split("== Physical Plan ==")[1].replace("LogicalRDD", "").split("Project")[0]
    assert [(r.report.sha256, r.source.sha256) for r in ready.collect()] == [("c", "d")]
    assert sorted((r.unit_id, r.offender) for r in rejects.collect()) == [("2", "source_archive"), ("3", "report_pdf"), ("4", "report_pdf")]
    whole = S.ready_submissions(submissions, artifacts)[0].first()
    assert (whole.report.artifact_id, whole.source.object_uri) == ("r3", "u")
    latest = S.latest_artifact(artifacts)
    assert latest.columns == artifacts.columns
    assert sorted(r.artifact_id for r in latest.collect()) == ["r3", "r4", "s1", "x"]


def test_audits_count_numbers_by_hash(spark):
    """one grouping of narrow statements; the same value said by two tables, and a hot value, are counted apart."""
    from quire.operators.quality import Declared, audit_tables

    parent = spark.createDataFrame([("1",), ("2",), ("2",)], "id STRING")
    child = spark.createDataFrame([("1",), ("9",), ("9",), (None,)], "p STRING")
    other = spark.createDataFrame([("9", 5), ("2", -1)], "q STRING, v INT")
    keys = {"child": [("parent", {"p": "id"})], "other": [("parent", {"q": "id"})]}
    found = audit_tables(
        {"parent": parent, "child": child, "other": other},
        Declared({"other": {"v": "v > 0"}}, {"parent": ["id"]}, lambda name: keys.get(name, [])),
    )
    plan = _plan(found)
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    assert sorted((r.table, r.kind, r.rule, r.value, r.n) for r in found.collect()) == [
        ("child", "foreign", "p", '["9"]', 2), ("other", "check", "v", None, 1),
        ("other", "foreign", "q", '["9"]', 1), ("parent", "unique", "id", '["2"]', 2),
    ]


def test_names_of_archive_entries_do_not_travel(spark):
    """entries are sorted by number and by folded path; what else they have was judged before."""
    from quire.operators.archives import admit_archives

    rows = [(1, 1, "a.py", 5, 5, "regular"), (1, 2, "A.py", 5, 5, "regular"), (2, 1, "../x", 5, 5, "symlink"), (3, 1, "b", 60, 60, "none"),
            (3, 2, "c", 60, 60, "none"), (4, 1, "d", 500, 1, "regular"), (5, 1, "e", 5, 5, "directory")]
    members = spark.createDataFrame(rows, "archive_id INT, entry_no INT, name STRING, file_size LONG, compress_size LONG, mode STRING")
    judged = admit_archives(members, max_total=100, max_file=1000, max_ratio=100)
    windows = [x for x in judged._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in x]
    assert windows and not any("mode" in x or "parts" in x for x in windows)
    assert sorted((r.archive_id, r.message, r.first_bad_entry) for r in judged.collect()) == [
        (1, "duplicate or special entry", 2), (2, "unsafe path", 1), (3, "extraction quota", 2), (4, "extraction quota", 1), (5, None, None)]


def test_members_are_dealt_before_equal_ones_go(spark):
    """no task holds a table of all values of the file it reads."""
    from quire.operators.submissions import admit_submissions

    submissions = spark.createDataFrame([(1, 1, 1, 1, 1), (2, 2, 2, 1, 2)], "submission_id LONG, project_id LONG, group_id LONG, submitted_by_user_id LONG, rubric_version_id LONG")
    projects = spark.sql("SELECT id AS project_id, 'open' AS status FROM range(1, 3)")
    rubrics = spark.sql("SELECT id AS rubric_version_id, id AS project_id, 'published' AS status FROM range(1, 3)")
    members = spark.sql("SELECT 1L AS group_id, 1L AS project_id, explode(array(1L, 1L, 2L)) AS user_id")
    accepted, rejects = admit_submissions(submissions, projects, rubrics, members)
    plan = accepted._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan
    assert [r.submission_id for r in accepted.collect()] == [1]
    assert [(r.unit_id, r.message) for r in rejects.collect()] == [("2", "user is not in group")]


def test_edges_are_counted_without_their_ends(spark, sf_dir, monkeypatch):
    """what neither deduplication nor counts read is not written."""
    seen, dedupe = [], G.dedupe_edges
    monkeypatch.setattr(G, "dedupe_edges", lambda edges: seen.append(edges.columns) or dedupe(edges))
    assert graph_queries.dedupe_edge_rejects(spark, sf_dir).count() and graph_queries.provenance_summary(spark, sf_dir).count()
    assert len(seen) == 2 and not any({"source", "target", "relation"} & set(columns) for columns in seen)


def test_claims_are_batched_once_and_dropped_without_a_move(spark, sf_dir, monkeypatch):
    """one grouping serves what is asked and what is answered; rejects are known before claims are dropped."""
    from checks import claim_queries
    from quire.operators import claims as C

    calls, group = [], C.group_section_text
    monkeypatch.setattr(C, "group_section_text", lambda *a: calls.append(1) or group(*a))
    claims = claim_queries.build_claim_tables(spark, sf_dir)
    assert len(calls) == 1 and "SortMergeJoin" not in _plan(claims)


def test_claims_are_the_same_with_and_without_prepared_batches(spark, sf_dir):
    from checks import inputs
    from quire.plans import claims as plan

    blocks = inputs.parsed_blocks(spark, sf_dir)
    prepared = plan.prepare_claim_batches(blocks, 3000)
    responses = materialize(inputs.claim_responses(inputs.claim_rows(prepared.batched, True), True))
    given = plan.build_claim_tables(blocks, responses, inputs.MODEL, 3000, prepared)
    alone = plan.build_claim_tables(blocks, responses, inputs.MODEL, 3000)
    for one, other in zip(given, alone):
        rows = [sorted(map(str, df.collect())) for df in (one, other)]
        assert rows[0] and rows[0] == rows[1]


def test_small_units_are_numbered_where_they_are_dealt(spark):
    """rows of small units move once and are not written; their numbers need no join. Hashes travel packed."""
    from quire.operators import submissions as S

    rows = materialize(
        spark.range(6000).selectExpr(
            "IF(id % 3 = 0 AND id < 3000, -1, id % 900) AS submission_id", "IF(id % 2 = 0, 'report_pdf', 'x') AS kind",
            "id % 5 AS version_no",
            "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 7 = 0 THEN upper(sha2(CAST(id AS STRING), 256)) WHEN id % 13 = 0"
            " THEN CAST(id AS STRING) ELSE sha2(CAST(id AS STRING), 256) END AS sha256",
        )
    )
    rows.createOrReplaceTempView("listed_rows")
    order = "PARTITION BY submission_id ORDER BY kind, version_no DESC, sha256 DESC"
    expected = spark.sql(f"SELECT *, row_number() OVER ({order}) AS position FROM listed_rows")
    mixed = S.list_artifacts(rows, segments=16)  # one unit of 1,000 rows, dealt by ranges
    assert sorted(map(str, mixed.collect())) == sorted(map(str, expected.collect()))
    small = S.list_artifacts(rows.where("submission_id >= 0"), segments=16)
    assert "Join" not in _plan(small) and _plan(small).count("Exchange") == 1
    wanted = expected.where("submission_id >= 0")
    assert sorted(map(str, small.collect())) == sorted(map(str, wanted.collect()))
    lost = spark.createDataFrame([(None, 2), (None, 1), (1, 5)], "unit LONG, at INT")
    assert position_in_unit(lost, ["unit"], ["at"], segments=16).count() == 3


def test_row_groups_of_megabyte_rows_stay_small(spark, tmp_path):
    """what a reader unpacks at once is bounded by bytes, also where rows pack well and small ones come first."""
    import pyarrow.parquet as pq

    from quire.sources.store import Part, Store

    text = "array_join(transform(sequence(1, 16000), i -> sha2(CAST(i % 700 + id AS STRING), 256)), ',')"
    rows = spark.range(0, 300, 1, 1).selectExpr("1 AS unit", "id", f"IF(id < 200, 'x', {text}) AS json")
    Store(spark, str(tmp_path)).write([Part("t", rows, "unit")])
    stored = spark.read.parquet(f"{tmp_path}/data/t")
    for table in (materialize(rows), stored):
        files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in table.inputFiles()]
        groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
        assert sum(g.num_rows for g in groups) == 300 and len(groups) < 20
        assert max(g.total_byte_size for g in groups) < 32 << 20
        assert table.agg(F.sum(F.octet_length("json"))).first()[0] == 200 + 100 * (16_000 * 65 - 1)


def test_parts_of_long_lists_are_gathered_by_tasks_of_a_few(spark, monkeypatch):
    """lists are gathered where their elements arrive, by as many tasks as their number asks for."""
    from quire.sources import sinks

    monkeypatch.setattr(sinks, "PARTS_OF_TASK", 2)
    edges = materialize(_edges(spark, 980))
    files = spark.createDataFrame([(1, "a.py", 9)], "graph_id LONG, path STRING, line_count INT")
    nodes = edges.limit(0).selectExpr("graph_id", "id", "rule AS kind", "rule AS name", "location", "provenance", "confidence", "reason", "rule")
    parts = graph_parts(nodes, edges, files, rows=50)
    assert re.search(r"hashpartitioning\(graph_id#\d+L?, part#\d+, part_no#\d+, 11\), REPARTITION_BY_NUM", _plan(parts))
    listed = parts.where("part = 'edges'").selectExpr("graph_id", "part_no", "explode(from_json('[' || json || ']', 'ARRAY<STRUCT<id: STRING>>').id) AS id")
    assert parts.where("part = 'edges'").count() == 21  # 3 graphs of 326 or 327 edges
    assert sorted((r.graph_id, r.id) for r in listed.collect()) == sorted((r.graph_id, r.id) for r in edges.collect())


def test_tables_that_pack_well_are_not_broadcast(spark):
    """the driver builds each broadcast, so a table counts as what its rows take and not as what its file does."""
    from quire.session import UNPACKED, sized_by_rows

    factor = "spark.sql.sources.fileCompressionFactor"
    packed = materialize(spark.range(50_000).selectExpr("concat('s', id DIV 2) AS k", "'a message that is the same' AS message"))
    size = sum(os.path.getsize(f.removeprefix("file://")) for f in packed.inputFiles())
    assert size * UNPACKED < 50_000 * 80  # bytes that its rows take
    large = spark.range(3_000_000).selectExpr("concat('s', id) AS k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(2 * size))
    try:
        assert "BroadcastHashJoin" in _plan(large.join(packed, "k"))
        with sized_by_rows(spark):
            with sized_by_rows(spark):
                assert float(spark.conf.get(factor)) == UNPACKED
            assert "BroadcastHashJoin" not in _plan(large.join(packed, "k"))
        assert spark.conf.get(factor, None) is None
        spark.conf.set(factor, "20.0")
        with sized_by_rows(spark):
            assert float(spark.conf.get(factor)) == 20
        assert float(spark.conf.get(factor)) == 20
    finally:
        spark.conf.unset(factor)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_layer_is_planned_by_rows(spark, monkeypatch):
    """all joins of a run are planned so, and the session's setting returns when it fails."""
    from types import SimpleNamespace

    from quire.plans import layer1

    seen, factor = [], "spark.sql.sources.fileCompressionFactor"

    def refused(*_):
        seen.append(spark.conf.get(factor, None))
        raise KeyError

    monkeypatch.setattr(layer1, "admit_ready", refused)
    with pytest.raises(KeyError):
        layer1.run_layer1(SimpleNamespace(submissions=spark.range(1), artifacts=None, ledger=None), "m", "v", None, None)
    assert seen and float(seen[0]) > 1 and spark.conf.get(factor, None) is None
