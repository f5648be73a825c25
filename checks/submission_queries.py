"""Queries over submissions, artifacts, data quality and the run ledger."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import register
from quire.functions import ids
from quire.operators import ledger as R
from quire.operators import quality as Q
from quire.operators import submissions as S
from quire.operators.scan import position_in_unit
from quire.plans import layer1
from quire.schemas import ROW_CHECKS, foreign_keys, schema_of
from quire.session import materialize, scratch_folder, sized_by_rows
from quire.sources.binary import ingest_binary as ingest
from quire.sources.sinks import read_graph_elements
from quire.sources.store import Store
from quire.sources.tables import read_table as read_declared
from quire.sources.tables import write_table


@register("""
    SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS project_id,
           (1 + o_orderkey % 3)::BIGINT AS attempt_no,
           CASE o_orderstatus WHEN 'O' THEN 'uploaded' WHEN 'P' THEN 'processing'
                ELSE 'completed' END AS status,
           o_orderdate AS submitted_at
    FROM orders""")
def read_table(spark, d):
    """Submissions written as a declared table and scanned with its fixed schema."""
    folder = scratch_folder(spark)
    rows = I.submissions(spark, d).withColumnsRenamed(
        {"submission_id": "id", "received_at": "submitted_at"}
    )
    write_table(rows, folder, "submissions")
    return read_declared(spark, folder, "submissions").select(
        "id", "project_id", "attempt_no", "status", "submitted_at"
    )


@register("""
    SELECT sum(length(c_name) + 1)::BIGINT AS byte_size,
           sha256(string_agg(c_name || chr(10), '' ORDER BY c_custkey)) AS sha256,
           NULL::VARCHAR AS code
    FROM customer GROUP BY c_nationkey""")
def ingest_binary(spark, d):
    """A file of customer names for each nation, measured and hashed as report uploads."""
    folder = scratch_folder(spark)
    (
        I.table(spark, d, "customer")
        .repartition("c_nationkey")
        .sortWithinPartitions("c_nationkey", "c_custkey")
        .select("c_name", "c_nationkey")
        .write.partitionBy("c_nationkey")
        .option("extension", "pdf")
        .csv(f"{folder}/uploads")
    )
    measured = ingest(spark, f"{folder}/uploads", S.REPORT, media_type="application/pdf")
    return measured.select("byte_size", "sha256", "code")


@register("""
    SELECT 'unsupported_media_type' AS code, 14::BIGINT AS n""")
def ingest_binary_refusals(spark, d):
    """The given tables as uploads: none of them has the name of a report."""
    names = [
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
    ]
    measured = ingest(spark, d, S.REPORT, media_type="application/pdf")
    of = F.regexp_extract("path", r"/(\w+)\.parquet", 1)
    return (
        measured.filter(of.isin(*names))
        .groupBy("code")
        .agg(F.count_distinct(of).alias("n"))
    )


@register("""
    SELECT artifact_id AS unit_id,
           CASE WHEN measured_size > byte_size THEN 'payload_too_large'
                WHEN measured_sha256 <> sha256 THEN 'conflict' ELSE 'bad_request' END AS code,
           CASE WHEN measured_size > byte_size THEN 'larger than declared'
                WHEN measured_sha256 <> sha256 THEN 'checksum or size changed'
                ELSE 'invalid PDF signature' END AS message,
           measured_size::VARCHAR AS offender
    FROM artifacts JOIN measured USING (artifact_id)
    WHERE measured_size > byte_size OR measured_sha256 <> sha256
       OR (kind = 'report_pdf' AND NOT signed)""")
def verify_artifact(spark, d):
    return S.verify_artifact(I.artifacts(spark, d), I.measured(spark, d))[1]


@register("""
    SELECT artifact_id, object_uri, l_partkey % 11 > 2 AS uri_ok FROM artifacts""")
def validate_object_uri(spark, d):
    return S.validate_object_uri(I.artifacts(spark, d), "corpus", "authenticated").select(
        "artifact_id", "object_uri", "uri_ok"
    )


@register("""
    SELECT submission_id::VARCHAR AS unit_id, 'invalid_state_transition' AS code,
           'submission is not uploaded' AS message, status AS offender
    FROM submissions WHERE status <> 'uploaded'""")
def lifecycle_gate(spark, d):
    return S.lifecycle_gate(I.submissions(spark, d))[1]


@register("""
    SELECT submission_id, 'processing' AS status FROM submissions WHERE status = 'uploaded'""")
def lifecycle_started(spark, d):
    return S.lifecycle_gate(I.submissions(spark, d))[0].select("submission_id", "status")


ADMIT = """
    SELECT s.submission_id, s.project_id,
           CASE WHEN p.status IS DISTINCT FROM 'open' THEN 'project is not open'
                WHEN r.status IS DISTINCT FROM 'published' THEN 'rubric is not published'
                WHEN s.submitted_by_user_id > 4 THEN 'user is not in group'
                WHEN r.project_id <> s.project_id THEN 'rubric of another project' END AS message
    FROM submissions s LEFT JOIN projects p ON p.project_id = s.project_id
    LEFT JOIN rubrics r ON r.rubric_version_id = s.rubric_version_id"""


@register(f"""
    SELECT submission_id::VARCHAR AS unit_id,
           CASE WHEN message = 'user is not in group' THEN 'forbidden'
                WHEN message = 'rubric of another project' THEN 'duplicate_resource'
                ELSE 'invalid_state_transition' END AS code,
           message, project_id::VARCHAR AS offender
    FROM ({ADMIT}) WHERE message IS NOT NULL""")
def admit_submissions(spark, d):
    return _admitted(spark, d)[1]


@register(f"SELECT submission_id FROM ({ADMIT}) WHERE message IS NULL")
def admitted_submissions(spark, d):
    return _admitted(spark, d)[0].select("submission_id")


def _admitted(spark, d):
    return S.admit_submissions(
        I.submissions(spark, d), I.projects(spark, d), I.rubrics(spark, d), I.members(spark, d)
    )


@register("""
    SELECT request_id,
           CASE WHEN known IS NULL OR (rank = 1 AND known.id = request_id) THEN 'new'
                WHEN project_id = known.project_id AND group_id = known.group_id
                 AND submitted_by_user_id = known.submitted_by_user_id
                 AND rubric_version_id = known.rubric_version_id
                 AND attempt_no = known.attempt_no THEN 'replay'
                ELSE 'conflict' END AS outcome,
           CASE WHEN known IS NULL OR (rank = 1 AND known.id = request_id) THEN NULL
                ELSE known.id END AS existing_id
    FROM requests q LEFT JOIN
      (SELECT idempotency_key, min(rank) AS rank,
              arg_min({'id': id, 'project_id': project_id, 'group_id': group_id,
                       'submitted_by_user_id': submitted_by_user_id,
                       'rubric_version_id': rubric_version_id, 'attempt_no': attempt_no},
                      {'a': rank, 'b': seen, 'c': id}) AS known
       FROM (SELECT 0 AS rank, TIMESTAMP '1970-01-01' AS seen, submission_id AS id,
                    * EXCLUDE (submission_id) FROM stored
             UNION ALL
             SELECT 1, received_at, request_id, * EXCLUDE (request_id) FROM requests)
       WHERE idempotency_key IS NOT NULL GROUP BY idempotency_key) k
      ON k.idempotency_key = q.idempotency_key""")
def resolve_idempotency(spark, d):
    requests, stored = I.requests_and_stored(spark, d)
    return S.resolve_idempotency(requests, stored).select("request_id", "outcome", "existing_id")


@register("""
    SELECT request_id::VARCHAR AS unit_id, 'duplicate_resource' AS code,
           'attempt exists' AS message, project_id || '/' || group_id || '/' || attempt_no
             AS offender
    FROM (SELECT *, row_number() OVER (PARTITION BY project_id, group_id, attempt_no
                                       ORDER BY received_at, request_id) AS nth FROM requests) q
    WHERE nth > 1 OR EXISTS (FROM stored s WHERE s.project_id = q.project_id
                               AND s.group_id = q.group_id AND s.attempt_no = q.attempt_no)""")
def reject_repeated_attempts(spark, d):
    return S.reject_repeated_attempts(*I.requests_and_stored(spark, d))[1]


@register("""
    SELECT submission_id, kind, version_no, sha256 FROM artifacts
    QUALIFY row_number() OVER (PARTITION BY submission_id, kind
                               ORDER BY version_no DESC, sha256 DESC) = 1""")
def latest_artifact(spark, d):
    slim = I.artifacts(spark, d).select("submission_id", "kind", "version_no", "sha256")
    return S.latest_artifact(slim)


READY = """
    SELECT s.submission_id, s.status, r.sha256 AS report_sha, c.sha256 AS source_sha
    FROM submissions s
    LEFT JOIN (SELECT submission_id, arg_max(sha256, (version_no, sha256)) AS sha256
               FROM artifacts WHERE kind = 'report_pdf' GROUP BY 1) r
      ON r.submission_id = s.submission_id
    LEFT JOIN (SELECT submission_id, arg_max(sha256, (version_no, sha256)) AS sha256
               FROM artifacts WHERE kind = 'source_archive' GROUP BY 1) c
      ON c.submission_id = s.submission_id"""


@register(f"""
    SELECT submission_id, report_sha, source_sha FROM ({READY})
    WHERE report_sha IS NOT NULL AND source_sha IS NOT NULL""")
def ready_submissions(spark, d):
    ready, _ = S.ready_submissions(I.submissions(spark, d), I.artifacts(spark, d), keep=[])
    return ready.select(
        "submission_id",
        F.col("report.sha256").alias("report_sha"),
        F.col("source.sha256").alias("source_sha"),
    )


@register(f"""
    SELECT submission_id::VARCHAR AS unit_id, 'artifact_not_found' AS code,
           'latest artifact missing' AS message,
           CASE WHEN report_sha IS NULL THEN 'report_pdf' ELSE 'source_archive' END AS offender
    FROM ({READY}) WHERE report_sha IS NULL OR source_sha IS NULL""")
def ready_rejects(spark, d):
    return S.ready_submissions(I.submissions(spark, d), I.artifacts(spark, d))[1]


def _wanted(spark, d):
    """Requests for artifacts, some naming the other kind or another submission."""
    return I.artifacts(spark, d).selectExpr(
        "submission_id + IF(l_partkey % 19 = 0, 1, 0) AS submission_id",
        "artifact_id",
        "IF(l_partkey % 7 = 0, 'report_pdf', kind) AS kind",
    )


@register("""
    SELECT submission_id, artifact_id, kind FROM artifacts
    WHERE l_partkey % 19 <> 0 AND (l_partkey % 7 <> 0 OR kind = 'report_pdf')""")
def owned_artifacts(spark, d):
    return S.owned_artifacts(_wanted(spark, d), I.artifacts(spark, d))[0]


@register("""
    SELECT (submission_id + CASE WHEN l_partkey % 19 = 0 THEN 1 ELSE 0 END)::VARCHAR AS unit_id,
           'artifact_not_found' AS code, 'artifact not owned' AS message, artifact_id AS offender
    FROM artifacts
    WHERE l_partkey % 19 = 0 OR (l_partkey % 7 = 0 AND kind <> 'report_pdf')""")
def owned_rejects(spark, d):
    return S.owned_artifacts(_wanted(spark, d), I.artifacts(spark, d))[1]


@register("""
    SELECT submission_id, kind, version_no, sha256,
           row_number() OVER (PARTITION BY submission_id
                              ORDER BY kind, version_no DESC, sha256 DESC) AS position
    FROM artifacts""")
def list_artifacts(spark, d):
    slim = I.artifacts(spark, d).select("submission_id", "kind", "version_no", "sha256")
    return S.list_artifacts(slim)


@register("""
    SELECT artifact_id AS unit_id,
           CASE WHEN l_partkey % 29 = 0 THEN 'parser_error' ELSE 'conflict' END AS code,
           CASE WHEN l_partkey % 29 = 0 THEN 'wrong artifact' ELSE 'source changed' END AS message,
           CASE WHEN l_partkey % 29 = 0 THEN 'other' ELSE artifact_id END AS offender
    FROM artifacts WHERE l_partkey % 29 = 0 OR l_partkey % 17 = 0""")
def audit_lineage(spark, d):
    outputs = I.artifacts(spark, d).selectExpr(
        "artifact_id",
        "IF(l_partkey % 29 = 0, 'other', artifact_id) AS output_artifact_id",
        "IF(l_partkey % 17 = 0, 'other', sha256) AS source_sha256",
    )
    return S.audit_lineage(outputs, I.artifacts(spark, d))


@register(f"""
    SELECT submission_id, sha256('{{"report":"' || report_sha ||
             '","schema_version":"1.0","source":"' || source_sha || '"}}') AS input_fingerprint
    FROM ({READY}) WHERE report_sha IS NOT NULL AND source_sha IS NOT NULL""")
def fingerprints(spark, d):
    ready, _ = S.ready_submissions(I.submissions(spark, d), I.artifacts(spark, d), keep=[])
    return R.with_input_fingerprint(ready).select("submission_id", "input_fingerprint")


LANES = " || ',' || ".join(
    f"sum(('0x' || substr(row, {1 + 15 * i}, 15))::BIGINT)::VARCHAR" for i in range(4)
)


@register(f"""
    SELECT submission_id, sha256(count(*) || ',' || {LANES}) AS output_fingerprint
    FROM (SELECT submission_id, sha256('{{"kind":"' || kind || '","version_no":' || version_no
                   || ',"sha256":"' || sha256 || '"}}') AS row
          FROM artifacts)
    GROUP BY submission_id""")
def output_fingerprints(spark, d):
    """Content hash of the artifacts of each submission; row hashes are summed, not listed."""
    rows = I.artifacts(spark, d).select("submission_id", "kind", "version_no", "sha256")
    return R.rows_fingerprint(rows, "submission_id", "output_fingerprint")


RULES = {
    **{k: v for k, v in ROW_CHECKS["artifacts"].items() if k != "byte_size"},
    "byte_size": "byte_size < 45000",
    "uri_scheme": "object_uri LIKE 'cloudinary:%'",
    "version_of_report": "kind <> 'report_pdf' OR version_no < 6",
}


@register("""
    SELECT artifact_id, unnest(list_filter([
             CASE WHEN byte_size >= 45000 THEN 'byte_size' END,
             CASE WHEN object_uri NOT LIKE 'cloudinary:%' THEN 'uri_scheme' END,
             CASE WHEN kind = 'report_pdf' AND version_no >= 6 THEN 'version_of_report' END],
             lambda r: r IS NOT NULL)) AS rule
    FROM artifacts""")
def audit_checks(spark, d):
    return Q.audit_checks(I.artifacts(spark, d), "artifact_id", RULES)


@register("""
    SELECT project_id, group_id, attempt_no, count(*) AS n FROM submissions
    GROUP BY ALL HAVING count(*) > 1""")
def audit_unique(spark, d):
    return Q.audit_unique(I.submissions(spark, d), ["project_id", "group_id", "attempt_no"])


@register("""
    SELECT idempotency_key, count(*) AS n FROM submissions WHERE idempotency_key IS NOT NULL
    GROUP BY ALL HAVING count(*) > 1""")
def audit_unique_partial(spark, d):
    return Q.audit_unique(I.submissions(spark, d), ["idempotency_key"])


@register("""
    SELECT rubric_version_id, project_id, count(*) AS n FROM submissions s
    WHERE NOT EXISTS (FROM rubrics r WHERE r.rubric_version_id = s.rubric_version_id
                        AND r.project_id = s.project_id)
    GROUP BY ALL""")
def audit_foreign_keys(spark, d):
    keys = next(keys for parent, keys in foreign_keys("submissions") if parent == "rubric_versions")
    rubrics = I.rubrics(spark, d).withColumnRenamed("rubric_version_id", "id")
    return Q.audit_foreign_keys(I.submissions(spark, d), rubrics, keys)


@register("""
    SELECT event_id, user_id, event_type, round(value * 100)::BIGINT AS cents FROM events
    WHERE event_id % 500 = 7 OR event_id % 700 = 9""")
def audit_append_only(spark, d):
    """The event log against a copy with some rows gone and some changed."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    old = I.table(spark, d, "events").select(
        "event_id", "user_id", "event_type", cents.alias("cents")
    )
    changed = F.expr("event_id % 700 = 9")
    new = old.filter("event_id % 500 <> 7").withColumn(
        "cents", F.when(changed, F.col("cents") + 1).otherwise(F.col("cents"))
    )
    return Q.audit_append_only(old, new)


@register("""
    SELECT coalesce(t.id, u.id) AS id,
           CASE WHEN u.id IS NOT NULL THEN u.status ELSE t.status END AS status,
           coalesce(t.created_at, TIMESTAMP '2025-01-01') AS created_at,
           CASE WHEN u.id IS NOT NULL THEN TIMESTAMP '2025-01-01' ELSE t.created_at END
             AS updated_at
    FROM (SELECT id, status, started_at AS created_at FROM runs
          WHERE started_at < TIMESTAMP '2024-01-20') t
    FULL JOIN (SELECT id, 'retried' AS status FROM runs
               WHERE status = 'failed' OR started_at >= TIMESTAMP '2024-01-20') u
      ON u.id = t.id""")
def touch_updated_at(spark, d):
    """Runs up to a day, updated by the later ones and by every failed one."""
    runs = I.runs(spark, d)
    later = F.col("started_at") >= F.lit("2024-01-20").cast("timestamp_ntz")
    target = runs.filter(~later).select(
        "id", "status", F.col("started_at").alias("created_at"),
        F.col("started_at").alias("updated_at"),
    )
    updates = runs.filter(later | (F.col("status") == "failed")).select(
        "id", F.lit("retried").alias("status")
    )
    now = F.lit("2025-01-01").cast("timestamp_ntz")
    return Q.touch_updated_at(target, updates, ["id"], now)


@register("SELECT id, submission_id, started_at, status FROM runs ORDER BY started_at DESC, id "
          "LIMIT 5")
def recent_runs(spark, d):
    return R.recent_runs(I.runs(spark, d), 5)


RUNS = f"""
    SELECT submission_id, sha256('{{"report":"' || report_sha || '","schema_version":"1.0",'
             || '"source":"' || source_sha || '"}}') AS input_fingerprint
    FROM ({READY})
    WHERE status = 'uploaded' AND report_sha IS NOT NULL AND source_sha IS NOT NULL"""


@register(f"""
    SELECT submission_id::VARCHAR AS submission_id, input_fingerprint,
           CASE WHEN submission_id % 7 = 0 OR submission_id % 4 <> 1 THEN 'succeeded'
                ELSE 'failed' END AS status,
           CASE WHEN submission_id % 7 = 0 THEN 'earlier'
                WHEN submission_id % 4 <> 1 THEN 'now' END AS output_fingerprint
    FROM ({RUNS})""")
def record_runs(spark, d):
    """The submissions of user 0 ran before; of the others every fourth fails now."""
    uploaded, _ = S.lifecycle_gate(I.submissions(spark, d))
    ready, _ = S.ready_submissions(uploaded, I.artifacts(spark, d), keep=[])
    ready = materialize(R.with_input_fingerprint(ready))
    before = F.lit("2024-01-01").cast("timestamp")
    now = F.lit("2025-01-01").cast("timestamp")
    failing = F.expr("submission_id % 4 = 1")
    outcomes = ready.select(
        "submission_id",
        F.when(~failing, "now").alias("output_fingerprint"),
        F.when(failing, "parser_error").alias("error_code"),
        F.when(failing, "broken").alias("error_message"),
    )
    empty = spark.createDataFrame([], schema_of("pipeline_runs"))
    ran = ready.filter("submitted_by_user_id = 0")
    done = ran.select(
        "submission_id",
        F.lit("earlier").alias("output_fingerprint"),
        F.lit(None).cast("string").alias("error_code"),
        F.lit(None).cast("string").alias("error_message"),
    )
    ledger = R.record_runs(ran, done, empty, before, before)
    return R.record_runs(ready, outcomes, ledger, now, now).select(
        "submission_id", "input_fingerprint", "status", "output_fingerprint"
    )


def layer1_inputs(spark, d) -> layer1.Layer1Inputs:
    """One submission per document: its layout as report, two parts and their calls as code."""
    documents = I.table(spark, d, "documents").select("doc_id")
    submissions = documents.selectExpr(
        "doc_id AS submission_id", "IF(doc_id % 5 = 0, 'processing', 'uploaded') AS status"
    )
    artifacts = documents.selectExpr(
        "doc_id AS submission_id",
        "explode(array('report_pdf', 'source_archive')) AS kind",
    ).filter("kind = 'report_pdf' OR submission_id % 9 <> 0")
    artifacts = artifacts.selectExpr(
        "submission_id",
        "concat(left(kind, 1), submission_id) AS artifact_id",
        "kind",
        "1 AS version_no",
        "1000L AS byte_size",
        "sha2(concat(left(kind, 1), submission_id), 256) AS sha256",
        "'' AS object_uri",
    )
    measured = artifacts.selectExpr(
        "artifact_id",
        "1000L AS measured_size",
        "IF(submission_id % 13 = 0 AND kind = 'report_pdf'"
        " OR submission_id % 17 = 0 AND kind <> 'report_pdf', 'x', sha256) AS measured_sha256",
        "CAST('%PDF-' AS BINARY) AS head",
    )
    pages = I.layout_pages(I.damaged_blocks(spark, d)).filter("artifact_id % 19 <> 3")
    batched = materialize(I.batched_candidates(spark, d, I.CLAIM_BATCH_CHARS))
    responses = I.claim_responses(I.claim_rows(batched, True), True)
    report_id = F.concat(F.lit("r"), F.col("artifact_id"))
    source_id = F.expr("concat('s', CAST({0} AS BIGINT) DIV 2)".format("id"))
    nodes = I.raw_nodes(spark, d).withColumn("graph_id", source_id)
    edges = (
        I.raw_edges(spark, d)
        .withColumn("graph_id", F.expr("concat('s', CAST(source AS BIGINT) DIV 2)"))
        .withColumn("target", F.expr("CAST(CAST(source AS BIGINT) DIV 2 * 2 + "
                                     "CAST(target AS BIGINT) % 3 AS STRING)"))
    )
    inventory = nodes.filter("source_file IS NOT NULL").selectExpr(
        "graph_id", "source_file AS path", "IF(graph_id LIKE '%4', 40, 60) AS line_count"
    )
    started = F.lit("2024-01-01").cast("timestamp")
    empty = spark.createDataFrame([], schema_of("pipeline_runs"))
    earlier = submissions.filter("submission_id % 11 = 0").select(
        "submission_id",
        ids.input_fingerprint(
            F.sha2(F.concat(F.lit("r"), "submission_id"), 256),
            F.sha2(F.concat(F.lit("s"), "submission_id"), 256),
            R.SCHEMA_VERSION,
        ).alias("input_fingerprint"),
    )
    done = earlier.select(
        "submission_id",
        F.lit("earlier").alias("output_fingerprint"),
        F.lit(None).cast("string").alias("error_code"),
        F.lit(None).cast("string").alias("error_message"),
    )
    return layer1.Layer1Inputs(
        submissions=submissions,
        artifacts=materialize(artifacts),
        measured=measured,
        layout_pages=pages.withColumn("artifact_id", report_id),
        responses=responses.filter("artifact_id % 23 <> 4").withColumn("artifact_id", report_id),
        raw_nodes=nodes,
        raw_edges=edges,
        graphs=nodes.select("graph_id").distinct().selectExpr(
            "graph_id",
            "false AS parse_failed",
            "graph_id AS source_artifact_id",
            "IF(graph_id LIKE '%8', 'x', sha2(graph_id, 256)) AS source_sha256",
        ),
        inventory=inventory.distinct(),
        ledger=materialize(R.record_runs(earlier, done, empty, started, started)),
    )


LAYER1_FAULTS = """
    WITH pair_edges AS (
      SELECT 's' || (source::BIGINT // 2) AS graph_id, source, source::BIGINT // 2 * 2
               + target::BIGINT % 3 AS target, relation, source_location, source_file, tag, score,
             end_line
      FROM raw_edges),
    pair_kept AS (
      SELECT *, CASE WHEN source_file IS NULL OR (tag = 'INFERRED' AND score IS NULL)
                     THEN 'AMBIGUOUS|' ELSE tag || '|' || coalesce(score,
                       CASE WHEN tag = 'EXTRACTED' THEN 1.0 END, -1) END AS evidence
      FROM pair_edges e
      WHERE EXISTS (FROM raw_nodes n WHERE n.id = e.target::VARCHAR
                      AND n.id::BIGINT // 2 = e.source::BIGINT // 2)),
    graph_faults AS (
      SELECT graph_id FROM pair_kept
      GROUP BY graph_id, source, target, relation, source_location, source_file
      HAVING count(DISTINCT evidence) > 1
      UNION
      SELECT graph_id FROM pair_kept WHERE source_file IS NOT NULL
        AND end_line > CASE WHEN graph_id LIKE '%4' THEN 40 ELSE 60 END
      UNION
      SELECT 's' || (id::BIGINT // 2) FROM raw_nodes WHERE source_file IS NOT NULL
        AND end_line > CASE WHEN id::BIGINT // 2 % 10 = 4 THEN 40 ELSE 60 END),
    report_faults AS (
      SELECT doc_id FROM doc_lines
        WHERE (doc_id * 5 + i) % 97 = 0 OR doc_id % 19 = 3
      UNION SELECT artifact_id FROM grouped WHERE len(content) > 24000
      UNION SELECT artifact_id FROM batched WHERE artifact_id % 23 = 4
      UNION SELECT artifact_id FROM claims_said
        WHERE artifact_id % 40 = 0 OR (artifact_id * 3 + i) % 150 = 0
           OR (artifact_id * 3 + i) % 151 = 0 OR (artifact_id * 3 + i) % 152 = 0
           OR (artifact_id * 3 + i) % 153 = 0 OR (artifact_id * 3 + i) % 154 = 0)"""


@register(f"""{LAYER1_FAULTS}
    SELECT doc_id::VARCHAR AS submission_id,
           CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'conflict'
                WHEN doc_id IN (FROM report_faults) THEN 'parser_error'
                WHEN doc_id % 17 = 0 THEN 'conflict'
                WHEN 's' || doc_id IN (FROM graph_faults) THEN 'parser_error'
                WHEN NOT EXISTS (FROM raw_nodes n WHERE n.id::BIGINT // 2 = doc_id)
                THEN 'internal_error' WHEN doc_id % 10 = 8 THEN 'conflict' END AS error_code
    FROM documents
    WHERE doc_id % 11 = 0 OR (doc_id % 5 <> 0 AND doc_id % 9 <> 0)""")
def run_layer1(spark, d):
    """The ledger after both branches ran for every ready submission."""
    stamp = F.lit("2025-01-01").cast("timestamp")
    done = layer1.run_layer1(
        layer1_inputs(spark, d), I.MODEL, "1.2.3", stamp, stamp, I.CLAIM_BATCH_CHARS
    )
    return done.ledger.select(
        "submission_id", F.get_json_object("error", "$.code").alias("error_code")
    )


def with_archives(inputs: layer1.Layer1Inputs) -> layer1.Layer1Inputs:
    """The inventory's files as archives: as many lines each, members that declare them, some wrongly."""
    files = inputs.inventory.select(
        F.col("graph_id").alias("archive_id"),
        "path",
        F.expr("repeat('x\n', line_count)").cast("binary").alias("content"),
    )
    files = materialize(files)
    number = "CAST(substr(archive_id, 2) AS BIGINT)"
    sized = files.selectExpr("archive_id", "path", "CAST(octet_length(content) AS BIGINT) AS size")
    members = position_in_unit(sized, ["archive_id"], ["path"], "entry_no").selectExpr(
        "archive_id",
        "entry_no",
        f"IF({number} % 31 = 2, concat('../', path), path) AS name",
        f"CASE WHEN {number} % 29 = 1 THEN size + 1 WHEN {number} % 37 = 3 THEN size - 1 ELSE size END AS file_size",
        "size DIV 2 AS compress_size",
        "'regular' AS mode",
    )
    return replace(inputs, inventory=None, members=members, files=files)


@register(f"""{LAYER1_FAULTS},
    refused AS (
      SELECT DISTINCT id::BIGINT // 2 AS doc_id,
             CASE WHEN id::BIGINT // 2 % 31 = 2 OR id::BIGINT // 2 % 29 = 1 THEN 'bad_request'
                  WHEN id::BIGINT // 2 % 37 = 3 THEN 'payload_too_large' END AS code
      FROM raw_nodes WHERE source_file IS NOT NULL),
    ended AS (
      SELECT doc_id,
             CASE WHEN doc_id IN (FROM report_faults) THEN 'parser_error'
                  WHEN r.code IS NOT NULL THEN r.code
                  WHEN 's' || doc_id IN (FROM graph_faults) THEN 'parser_error'
                  WHEN NOT EXISTS (FROM raw_nodes n WHERE n.id::BIGINT // 2 = doc_id)
                  THEN 'internal_error' WHEN doc_id % 10 = 8 THEN 'conflict' END AS error_code
      FROM documents LEFT JOIN refused r USING (doc_id)
      WHERE doc_id % 11 <> 0 AND doc_id % 5 <> 0 AND doc_id % 9 <> 0),
    tried AS (
      SELECT *, doc_id % 2 = 0 AND (error_code IS NOT NULL OR doc_id % 13 = 0 OR doc_id % 17 = 0) AS again,
             (SELECT count(DISTINCT source_file) FROM raw_nodes n WHERE n.id::BIGINT // 2 = doc_id) AS n_files
      FROM ended)
    SELECT doc_id::VARCHAR AS submission_id, CASE WHEN again THEN 2 ELSE 1 END::BIGINT AS attempt_no, error_code,
           CASE WHEN error_code IS NULL THEN (SELECT count(*) FROM sections s WHERE s.artifact_id = doc_id) ELSE 0 END
             AS n_sections,
           CASE WHEN error_code IS NULL THEN (SELECT count(*) FROM parsed p WHERE p.artifact_id = doc_id)
             + (SELECT count(*) FROM citations c WHERE c.artifact_id = doc_id) ELSE 0 END AS n_blocks,
           CASE WHEN error_code IS NULL THEN (SELECT count(*) FROM claims_said c WHERE c.artifact_id = doc_id)
             ELSE 0 END AS n_claims,
           CASE WHEN error_code IS NULL THEN (SELECT count(*) FROM raw_nodes n WHERE n.id::BIGINT // 2 = doc_id)
             ELSE 0 END AS n_nodes,
           CASE WHEN error_code IS NULL THEN n_files || ' files in ' || CASE WHEN n_files > 0 THEN 'python' ELSE '' END
             || ', ' || n_files * CASE WHEN doc_id % 10 = 4 THEN 80 ELSE 120 END || ' bytes' END AS repository
    FROM tried""")
def run_layer1_twice(spark, d):
    """One store after two jobs: even submissions first, then all, with what was measured wrongly mended.

    The second job skips what has succeeded, runs the odd ones, and tries the failed ones again. Read back
    is the last attempt of every run and what the store holds of it, whichever job wrote it.
    """
    with sized_by_rows(spark):
        inputs = with_archives(layer1_inputs(spark, d))
        first = replace(inputs, submissions=inputs.submissions.filter("submission_id % 2 = 0"))
        mended = inputs.measured.join(inputs.artifacts.select("artifact_id", "sha256"), "artifact_id")
        second = replace(inputs, measured=mended.withColumn("measured_sha256", F.col("sha256")).drop("sha256"))
        folder = scratch_folder(spark)
        for job, (lot, day) in enumerate([(first, "2025-01-01"), (second, "2025-01-02")], 1):
            stamp = F.lit(day).cast("timestamp")
            layer1.run_layer1(lot, I.MODEL, f"1.2.{job}", stamp, stamp, I.CLAIM_BATCH_CHARS, store=folder)
        store = Store(spark, folder)
        last = store.read("pipeline_runs").groupBy("submission_id").agg(F.max(F.struct("attempt_no", "error")).alias("run"))

        def counted(table: str, unit: str, name: str) -> DataFrame:
            return store.read(table).groupBy(F.regexp_replace(unit, "^[rs]", "").alias("submission_id")).agg(
                F.count("*").alias(name)
            )

        about = F.from_json(
            F.get_json_object("head", "$.repository"), "byte_size BIGINT, languages ARRAY<STRING>, manifests ARRAY<STRING>"
        )
        listed = read_graph_elements(spark, folder, "inventory", "path STRING, language STRING, byte_size BIGINT")
        files = listed.groupBy("graph_id").agg(F.count("*").alias("files"))
        heads = store.read("code_graphs").join(files, "graph_id", "left").select(
            F.expr("substr(graph_id, 2)").alias("submission_id"),
            F.col("node_count").alias("n_nodes"),
            F.concat(
                F.coalesce("files", F.lit(0)).cast("string"),
                F.lit(" files in "),
                F.coalesce(F.array_join(about["languages"], ","), F.lit("")),
                F.lit(", "),
                F.coalesce(about["byte_size"], F.lit(0)).cast("string"),
                F.lit(" bytes"),
            ).alias("repository"),
        )
        out = last.select(
            "submission_id",
            F.col("run.attempt_no").alias("attempt_no"),
            F.get_json_object("run.error", "$.code").alias("error_code"),
        )
        for table in (
            counted("document_sections", "artifact_id", "n_sections"),
            counted("document_blocks", "artifact_id", "n_blocks"),
            counted("claims", "submission_id", "n_claims"),
            heads,
        ):
            out = out.join(table, "submission_id", "left")
        return materialize(out.fillna(0, ["n_sections", "n_blocks", "n_claims", "n_nodes"]))


#: Rows of declared tables, in SQL that both engines read.
DECLARED = {
    "users": (
        "customer",
        "CAST(c_custkey AS STRING) AS id, CAST(c_custkey % 400 AS STRING) AS email,"
        " CASE WHEN c_custkey % 50 = 0 THEN 'owner' ELSE 'user' END AS global_role",
    ),
    "courses": (
        "supplier",
        "CAST(s_suppkey AS STRING) AS id, CAST(s_nationkey AS STRING) AS code, CAST(s_suppkey % 2 AS STRING) AS term,"
        " CASE WHEN s_suppkey % 9 = 0 THEN 'gone' ELSE 'active' END AS status,"
        " CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_suppkey * 31 AS STRING) END AS created_by",
    ),
    "projects": (
        "part",
        "CAST(p_partkey AS STRING) AS id, CAST(p_partkey % 15 AS STRING) AS course_id, 'open' AS status,"
        " p_size - 1 AS max_score, CAST(p_partkey * 2 AS STRING) AS created_by",
    ),
    "rubric_versions": (
        "customer",
        "CAST(c_custkey AS STRING) AS id, CAST(c_custkey AS STRING) AS project_id, c_nationkey AS version_no,"
        " CASE WHEN c_custkey % 6 = 0 THEN 'published' ELSE 'draft' END AS status, CAST(NULL AS TIMESTAMP) AS published_at,"
        " CAST(NULL AS STRING) AS created_by",
    ),
    "submissions": (
        "orders",
        "CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS project_id, CAST(o_custkey AS STRING) AS group_id,"
        " CAST(o_orderkey % 7 AS STRING) AS submitted_by_user_id,"
        " CAST(o_custkey + CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END AS STRING) AS rubric_version_id,"
        " o_orderkey % 3 AS attempt_no, CASE WHEN o_orderkey % 4 = 0 THEN concat('k', CAST(o_custkey AS STRING)) END"
        " AS idempotency_key, CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE 'completed' END AS status",
    ),
    "artifacts": (
        "lineitem",
        "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id, CAST(l_orderkey + CASE WHEN"
        " l_partkey % 97 = 0 THEN 1000000 ELSE 0 END AS STRING) AS submission_id,"
        " CASE WHEN l_partkey % 41 = 0 THEN 'scan' ELSE 'report_pdf' END AS kind, l_linenumber - 1 AS version_no,"
        " CAST(l_quantity AS BIGINT) - 2 AS byte_size, CASE WHEN l_suppkey % 7 = 0 THEN 'x' ELSE repeat('a', 64) END"
        " AS sha256, concat('u', CAST(l_partkey AS STRING)) AS object_uri",
    ),
    "pipeline_runs": (
        "events",
        "CAST(event_id AS STRING) AS id, CAST(user_id AS STRING) AS submission_id, 'L1' AS pipeline, 1 AS attempt_no,"
        " CAST(event_id % 10 AS STRING) AS input_fingerprint,"
        " CASE event_type WHEN 'error' THEN 'broken' ELSE 'succeeded' END AS status",
    ),
}
BROKEN = {
    "users global_role": "global_role NOT IN ('user', 'admin')",
    "courses status": "status NOT IN ('draft', 'active', 'archived')",
    "projects max_score": "max_score <= 0",
    "rubric_versions version_no": "version_no <= 0",
    "rubric_versions published_at": "status = 'published' AND published_at IS NULL",
    "submissions attempt_no": "attempt_no <= 0",
    "submissions status": "status = 'pending'",
    "artifacts kind": "kind = 'scan'",
    "artifacts version_no": "version_no <= 0",
    "artifacts byte_size": "byte_size < 0",
    "artifacts sha256": "sha256 = 'x'",
    "pipeline_runs status": "status = 'broken'",
}
KEYS = """users id; users email; courses id; courses code term; projects id; projects course_id; rubric_versions id;
    rubric_versions project_id version_no; submissions id; submissions project_id group_id attempt_no;
    submissions idempotency_key; artifacts id; artifacts object_uri version_no;
    artifacts submission_id kind version_no sha256; pipeline_runs id;
    pipeline_runs submission_id pipeline input_fingerprint attempt_no"""
REFERENCES = """courses created_by = users id; projects course_id = courses id; projects created_by = users id;
    rubric_versions project_id = projects id; submissions project_id = projects id;
    submissions submitted_by_user_id = users id; submissions rubric_version_id project_id = rubric_versions id project_id;
    artifacts submission_id = submissions id; pipeline_runs submission_id = submissions id"""


def _audit_sql() -> str:
    def value(columns: list[str]) -> str:
        return f"to_json([{', '.join(f'{c}::VARCHAR' for c in columns)}])::VARCHAR"

    def whole(columns: list[str]) -> str:
        return " AND ".join(f"{c} IS NOT NULL" for c in columns)

    parts = []
    for what, condition in BROKEN.items():
        table, rule = what.split()
        parts.append(f"SELECT '{table}' AS \"table\", 'check' AS kind, '{rule}' AS rule, NULL::VARCHAR AS value, count(*) AS n"
                     f" FROM d_{table} WHERE {condition} HAVING count(*) > 0")
    for what in KEYS.split(";"):
        table, *columns = what.split()
        parts.append(f"SELECT '{table}', 'unique', '{' '.join(columns)}', {value(columns)}, count(*) FROM d_{table}"
                     f" WHERE {whole(columns)} GROUP BY {', '.join(columns)} HAVING count(*) > 1")
    for what in REFERENCES.split(";"):
        (table, *columns), (parent, *keys) = (side.split() for side in what.split("="))
        same = " AND ".join(f"p.{k} = c.{c}" for k, c in zip(keys, columns))
        parts.append(f"SELECT '{table}', 'foreign', '{' '.join(columns)}', {value(columns)}, count(*) FROM d_{table} c"
                     f" WHERE {whole(columns)} AND NOT EXISTS (FROM d_{parent} p WHERE {same}) GROUP BY {', '.join(columns)}")
    tables = ", ".join(f"d_{name} AS (SELECT {columns} FROM {source})" for name, (source, columns) in DECLARED.items())
    return f"WITH {tables} {' UNION ALL '.join(parts)}"


@register(_audit_sql())
def audit_tables(spark, d):
    """Every declared check, key and reference of seven tables, each read once."""
    tables = {name: I.table(spark, d, source).selectExpr(*_columns(sql)) for name, (source, sql) in DECLARED.items()}
    return Q.audit_tables(tables)


def _columns(sql: str) -> list[str]:
    """Select items of a list whose commas at depth 0 separate them."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(sql):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(sql[last:i])
            last = i + 1
    return [*out, sql[last:]]
