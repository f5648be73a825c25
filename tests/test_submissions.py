"""Submission, quality, ledger, sink and streaming operators on literal rows."""

from datetime import datetime

from pyspark.sql import functions as F

from quire import schemas
from quire.operators import ledger as R
from quire.operators import quality as Q
from quire.operators import submissions as S
from quire.sources.binary import ingest_binary
from quire.sources.store import KeyedTable, Part, Store
from quire.streaming import intake

REQUEST = (
    "request_id INT, idempotency_key STRING, project_id INT, group_id INT,"
    " submitted_by_user_id INT, rubric_version_id INT, attempt_no INT, received_at INT"
)


def test_idempotency(spark):
    stored = spark.createDataFrame([(100, "k1", 1, 1, 1, 1, 1, 0)],
                                   REQUEST.replace("request_id", "submission_id"))
    requests = spark.createDataFrame(
        [
            (1, "k1", 1, 1, 1, 1, 1, 5), (2, "k1", 2, 1, 1, 1, 1, 5), (3, None, 1, 1, 1, 1, 2, 5),
            (4, "", 1, 1, 1, 1, 3, 5), (5, "k2", 1, 1, 1, 1, 4, 7), (6, "k2", 1, 1, 1, 1, 4, 6),
            (7, "k2", 1, 1, 1, 1, 5, 8),
        ],
        REQUEST,
    )
    got = {r.request_id: (r.outcome, r.existing_id)
           for r in S.resolve_idempotency(requests, stored).collect()}
    assert got == {
        1: ("replay", 100), 2: ("conflict", 100), 3: ("new", None), 4: ("new", None),
        5: ("replay", 6), 6: ("new", None), 7: ("conflict", 6),
    }


def test_object_uris(spark):
    good = "cloudinary://raw/authenticated/f/submissions/7/report_pdf/x"
    cases = {
        good: True, good + "/y.pdf": True, good[:-1]: False, good + "?a=1": False,
        good + "#a": False, good + "/..": False, good.replace("/x", "/./x"): False,
        good.replace("cloudinary", "http"): False, good.replace("raw", "image"): False,
        good.replace("authenticated", "upload"): False, good.replace("/7/", "/8/"): False,
        good.replace("report_pdf", "source_archive"): False, "x": False,
        "cloudinary://raw//authenticated/f/submissions/7/report_pdf/x": True,
    }
    df = spark.createDataFrame([(7, "report_pdf", u) for u in cases],
                               "submission_id INT, kind STRING, object_uri STRING")
    got = {r.object_uri: r.uri_ok
           for r in S.validate_object_uri(df, "f", "authenticated").collect()}
    assert got == cases


def test_verification_order(spark):
    rows = [
        ("ok", "report_pdf", 5, "h", 5, "h", b"\n %PDF-1", None),
        ("zero", "report_pdf", 0, "h", 0, "h", b"%PDF-", "payload_too_large"),
        ("limit", "report_pdf", 11, "h", 11, "h", b"%PDF-", "payload_too_large"),
        ("grown", "report_pdf", 5, "h", 6, "x", b"%PDF-", "payload_too_large"),
        ("short", "report_pdf", 5, "h", 4, "h", b"%PDF-", "conflict"),
        ("hash", "report_pdf", 5, "h", 5, "x", b"PK", "conflict"),
        ("sign", "report_pdf", 5, "h", 5, "h", b"PK", "bad_request"),
        ("zip", "source_archive", 15, "h", 15, "h", b"PK", None),
    ]
    artifacts = spark.createDataFrame([r[:4] for r in rows], "artifact_id STRING, kind STRING,"
                                      " byte_size BIGINT, sha256 STRING")
    measured = spark.createDataFrame(
        [(r[0], r[4], r[5], bytearray(r[6])) for r in rows],
        "artifact_id STRING, measured_size BIGINT, measured_sha256 STRING, head BINARY",
    )
    ok, rejects = S.verify_artifact(artifacts, measured,
                                    {"report_pdf": 10, "source_archive": 20})
    assert {r.unit_id: r.code for r in rejects.collect()} == {r[0]: r[7] for r in rows if r[7]}
    assert {r.artifact_id for r in ok.collect()} == {"ok", "zip"}


def test_ingest_faults(spark, tmp_path):
    for name, body in {"a.pdf": b"abc", "b.PDF": b"", "c.txt": b"x", "d.pdf": b"x" * 20}.items():
        (tmp_path / name).write_bytes(body)
    names = ["a.pdf", "b.PDF", "c.txt", "d.pdf", ""]
    declared = spark.createDataFrame([(n, "application/pdf") for n in names],
                                     "name STRING, media_type STRING")
    out = ingest_binary(spark, str(tmp_path), "report_pdf", declared, max_bytes=10)
    got = {r.name: (r.code, r.byte_size) for r in out.collect()}
    assert got == {"a.pdf": (None, 3), "b.PDF": ("bad_request", 0), "": ("bad_request", 0),
                   "c.txt": ("unsupported_media_type", 1), "d.pdf": ("payload_too_large", 20)}
    assert out.filter("name = 'a.pdf'").first().sha256.startswith("ba7816bf")
    wrong = ingest_binary(spark, str(tmp_path), "report_pdf", media_type="text/plain")
    assert {r.code for r in wrong.collect()} == {"unsupported_media_type"}
    slim = ingest_binary(spark, str(tmp_path), "report_pdf").select("name", "code")
    plan = slim._jdf.queryExecution().executedPlan().toString()
    assert "content#" not in plan


def test_declared_schemas_checks_and_keys(spark):
    assert len(schemas.TABLES) == 33
    for table in schemas.TABLES:
        empty = spark.createDataFrame([], schemas.schema_of(table))
        rules = schemas.ROW_CHECKS.get(table, {})
        if rules:
            assert Q.audit_checks(empty, empty.columns[0], rules).isEmpty()
        for key in schemas.UNIQUE_KEYS.get(table, []):
            assert set(key.split()) <= set(empty.columns)
        for parent, columns in schemas.foreign_keys(table):
            assert set(columns) <= set(empty.columns)
            assert set(columns.values()) <= set(schemas.schema_of(parent).fieldNames())


def test_checks_use_three_valued_logic(spark):
    rows = spark.createDataFrame(
        [("1", "draft", 1, None), ("2", "published", 1, None), ("3", None, None, None),
         ("4", "odd", 0, None)],
        "id STRING, status STRING, version_no INT, published_at TIMESTAMP",
    )
    got = sorted((r.id, r.rule) for r in
                 Q.audit_checks(rows, "id", schemas.ROW_CHECKS["rubric_versions"]).collect())
    assert got == [("2", "published_at"), ("4", "status"), ("4", "version_no")]


def test_unique_foreign_append_only(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (1, "a"), (1, "a"), (2, "b")],
                                 "p INT, k STRING")
    assert [tuple(r) for r in Q.audit_unique(rows, ["p", "k"]).collect()] == [(1, "a", 2)]
    parent = spark.createDataFrame([(1, "a")], "x INT, y STRING")
    lost = Q.audit_foreign_keys(rows, parent, {"p": "x", "k": "y"}).collect()
    assert [tuple(r) for r in lost] == [(2, "b", 1)]
    old = spark.createDataFrame([(1,), (1,), (2,)], "v INT")
    new = spark.createDataFrame([(1,), (2,), (3,)], "v INT")
    assert [r.v for r in Q.audit_append_only(old, new).collect()] == [1]


def test_ledger_skips_succeeded_and_replaces_failed(spark):
    when = F.lit("2024-01-01").cast("timestamp")
    ready = spark.createDataFrame([(1, "a"), (2, "b")], "submission_id INT, input_fingerprint STRING")
    shape = ("submission_id INT, output_fingerprint STRING, error_code STRING,"
             " error_message STRING")
    first = spark.createDataFrame([(1, "out", None, None), (2, None, "parser_error", "x")], shape)
    empty = spark.createDataFrame([], schemas.schema_of("pipeline_runs"))
    ledger = R.record_runs(ready, first, empty, when, when)
    assert {r.submission_id: r.status for r in ledger.collect()} == {"1": "succeeded",
                                                                     "2": "failed"}
    second = spark.createDataFrame([(1, "new", None, None), (2, "out2", None, None)], shape)
    after = R.record_runs(ready, second, ledger, when, when).collect()
    assert {r.submission_id: r.output_fingerprint for r in after} == {"1": "out", "2": "out2"}
    again = R.record_runs(ready, second.limit(0), empty, when, when).collect()
    assert {r.status for r in again} == {"failed"}


def test_input_fingerprint_is_the_canonical_json_digest(spark):
    import hashlib
    import json

    ready = spark.sql("SELECT named_struct('sha256', 'r') AS report,"
                      " named_struct('sha256', 's') AS source")
    want = json.dumps({"report": "r", "source": "s", "schema_version": "1.0"},
                      separators=(",", ":"), sort_keys=True)
    got = R.with_input_fingerprint(ready).first().input_fingerprint
    assert got == hashlib.sha256(want.encode()).hexdigest()


def test_rows_fingerprint_sees_content_not_order(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "a"), (3, "a")],
                                 "u INT, v STRING")
    got = {r.u: r.f for r in R.rows_fingerprint(rows, "u", "f").collect()}
    assert got[1] == got[2] != got[3]


def arrive(tmp_path, spark, name, lots, schema):
    folder = tmp_path / name
    for i, rows in enumerate(lots):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)),
            spark.read.schema(schema).parquet(str(folder)))


def test_stream_intake_over_batches(spark, tmp_path):
    t = datetime(2024, 1, 1)
    lots = [[(1, t, "a"), (2, t, None), (3, t, "b")], [(4, t, "a"), (5, t, None), (6, t, "c")]]
    stream, _ = arrive(tmp_path, spark, "in", lots,
                       "request_id INT, received_at TIMESTAMP, idempotency_key STRING")
    query = (intake.stream_intake(stream, "1 day").writeStream.format("parquet")
             .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
             .start(str(tmp_path / "out")))
    query.awaitTermination()
    got = sorted(r.request_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [1, 2, 3, 5, 6]


def test_stream_ready_equals_batch_over_batches(spark, tmp_path):
    t = datetime(2024, 1, 1)
    lots = [[(1, "report_pdf", 1, t), (2, "report_pdf", 1, t), (1, "source_archive", 1, t)],
            [(1, "report_pdf", 3, t), (2, "source_archive", 2, t), (3, "report_pdf", 1, t)],
            [(1, "report_pdf", 2, t)]]
    schema = "submission_id INT, kind STRING, version_no INT, registered_at TIMESTAMP"
    stream, table = arrive(tmp_path, spark, "in", lots, schema)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    intake.stream_ready(stream, out, checkpoint).awaitTermination()
    want = intake.newest_pairs(table).filter("report IS NOT NULL AND source IS NOT NULL")
    assert sorted(intake.ready_table(spark, out).collect()) == sorted(want.collect())
    intake.stream_ready(stream, out, checkpoint).awaitTermination()
    assert sorted(intake.ready_table(spark, out).collect()) == sorted(want.collect())


def test_stream_earliest_takes_late_rows(spark, tmp_path):
    def at(day):
        return datetime(2024, 1, day)

    lots = [[(7, at(9), "a"), (8, at(9), None), (3, at(5), "b")], [(1, at(2), "a"), (9, at(2), "")],
            [(2, at(2), "a"), (4, at(5), "b"), (8, at(9), None)]]
    stream, _ = arrive(tmp_path, spark, "in", lots,
                       "request_id INT, received_at TIMESTAMP, idempotency_key STRING")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    intake.stream_earliest(stream, out, checkpoint).awaitTermination()
    table = intake.earliest_requests(spark, out)
    assert sorted(r.request_id for r in table.read().collect()) == [1, 3, 8, 9]
    table.merge(table.read().limit(0), 1)  # a batch that was committed is left alone
    assert len(table.runs()) == 3


def test_replayed_batches_keep_files_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(KeyedTable, "COMPACT_AFTER", 4)
    table = KeyedTable(spark, str(tmp_path), "k", F.col("v"))
    want = {}
    for batch in range(30):
        k, v = batch % 3, (batch * 7) % 11
        want[k] = max(want.get(k, -1), v)
        for _ in range(2):  # replayed at once
            table.merge(spark.createDataFrame([(k, v), (k, v - 5)], "k INT, v INT"), batch, older_than_s=0)
    assert {r.k: r.v for r in table.read().collect()} == want
    assert len(list(tmp_path.rglob("*.json"))) <= 6 and len(list(tmp_path.rglob("*.parquet"))) <= 60
    table.merge(spark.createDataFrame([(0, 99)], "k INT, v INT"), 29)
    assert {r.k: r.v for r in table.read().collect()} == want


def test_newest_file_of_an_artifact(spark):
    old, new = datetime(2024, 1, 1), datetime(2024, 1, 2)
    rows = [(1, "zzz", old), (1, "aaa", new), (2, "x", old), (2, "x", old), (3, "p", None), (3, "q", old), (4, "m", new)]
    files = spark.createDataFrame(rows, "artifact_id INT, value STRING, modified_at TIMESTAMP")
    got = intake.newest_files(files).collect()
    assert sorted((r.artifact_id, r.value) for r in got) == [(1, "aaa"), (2, "x"), (3, "q"), (4, "m")]


def test_older_file_that_comes_later_does_not_replace(spark, tmp_path):
    def units(day):
        return spark.createDataFrame([(1, day)], "artifact_id INT, as_of BIGINT")

    def part(text, day):
        return Part("t", spark.createDataFrame([(1, text)], "artifact_id INT, text STRING"), "artifact_id", units(day))

    store = Store(spark, str(tmp_path))
    for batch, (text, day) in enumerate([("first", 10), ("older", 5), ("newer", 20), ("same time, later", 20)]):
        store.write_batch([part(text, day)], batch)
        store.write_batch([part("replayed", 99)], batch)
        want = ["first", "first", "newer", "same time, later"][batch]
        assert [r.text for r in store.read("t").collect()] == [want]
    store.compact()
    store.write_batch([part("oldest", 1)], 4)
    assert [r.text for r in store.read("t").collect()] == ["same time, later"]


def test_audit_of_all_tables_at_once(spark, sf_dir):
    declared = Q.Declared(
        {"a": {"size": "n >= 0"}, "b": {}},
        {"a": ["id", "n tag"], "b": ["id"]},
        {"a": [], "b": [("a", {"a_id": "id"}), ("gone", {"a_id": "id"})]}.get,
    )
    a = spark.createDataFrame([("x", 1, "t"), ("x", 1, "t"), ("y", -1, None), (None, 1, "u")], "id STRING, n INT, tag STRING")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, "z"), (3, None)], "id INT, a_id STRING")
    got = sorted(tuple(r) for r in Q.audit_tables({"a": a, "b": b}, declared).select("table", "kind", "rule", "value", "n").collect())
    assert got == [
        ("a", "check", "size", None, 1), ("a", "unique", "id", '["x"]', 2), ("a", "unique", "n tag", '["1","t"]', 2),
        ("b", "foreign", "a_id", '["z"]', 2), ("b", "unique", "id", '["3"]', 2),
    ]
    assert Q.audit_tables({"a": a.limit(0), "b": b.limit(0)}, declared).isEmpty()
    from checks.registry import QUERIES

    plan = QUERIES["audit_tables"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 7 and "Join" not in plan
