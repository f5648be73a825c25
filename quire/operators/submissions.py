"""Submissions and artifacts: admission, idempotency, lifecycle, pairing and verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import ids, text
from quire.operators.scan import position_in_unit
from quire.rejects import Code, first_failure, reject_rows

# Artifact kinds, accepted uploads, limits, storage scheme.
REPORT = "report_pdf"
SOURCE = "source_archive"
UPLOAD_SUFFIX = {REPORT: ".pdf", SOURCE: ".zip"}
UPLOAD_MEDIA_TYPES = {
    REPORT: ("application/pdf",),
    SOURCE: ("application/zip", "application/x-zip-compressed"),
}
MAX_UPLOAD_BYTES = {REPORT: 50 * 1024 * 1024, SOURCE: 200 * 1024 * 1024}
PDF_SIGNATURE = "%PDF-"
STORAGE_SCHEME = "cloudinary"
STORAGE_CLASS = "raw"

DECLARED_SIZE = "declared size"

REQUEST_FIELDS = (
    "project_id",
    "group_id",
    "submitted_by_user_id",
    "rubric_version_id",
    "attempt_no",
)


def lifecycle_gate(submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only uploaded submissions accept artifacts or start a run; started ones are processing."""
    uploaded = F.coalesce(F.col("status") == "uploaded", F.lit(False))
    rejects = reject_rows(
        submissions.filter(~uploaded),
        "submission_id",
        Code.INVALID_STATE_TRANSITION,
        "submission is not uploaded",
        F.col("status"),
    )
    return submissions.filter(uploaded).withColumn("status", F.lit("processing")), rejects


def admit_submissions(
    submissions: DataFrame, projects: DataFrame, rubrics: DataFrame, members: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Project open, rubric published, user in group, in that order; then the composite keys:
    the group and the rubric belong to the project."""
    yes = F.lit(True)

    def distinct(rows: DataFrame) -> DataFrame:
        """Equal rows are dealt to one task before they are dropped: a file's task keeps no table of all it has read."""
        return rows.repartition(*rows.columns).distinct()

    opened = projects.filter(F.col("status") == "open").select("project_id")
    published = rubrics.filter(F.col("status") == "published").select(
        "rubric_version_id", F.col("project_id").alias("_rubric_project")
    )
    member = distinct(members.select("group_id", F.col("user_id").alias("submitted_by_user_id")))
    member = member.withColumn("_member", yes)
    groups = distinct(members.select("group_id", "project_id")).withColumn("_own_group", yes)
    joined = (
        submissions.join(distinct(opened).withColumn("_open", yes), "project_id", "left")
        .join(distinct(published), "rubric_version_id", "left")
        .join(member, ["group_id", "submitted_by_user_id"], "left")
        .join(groups, ["group_id", "project_id"], "left")
    )
    fault = first_failure(
        (F.col("_open").isNull(), Code.INVALID_STATE_TRANSITION + "|project is not open"),
        (
            F.col("_rubric_project").isNull(),
            Code.INVALID_STATE_TRANSITION + "|rubric is not published",
        ),
        (F.col("_member").isNull(), Code.FORBIDDEN + "|user is not in group"),
        (F.col("_own_group").isNull(), Code.DUPLICATE_RESOURCE + "|group of another project"),
        (
            F.col("_rubric_project") != F.col("project_id"),
            Code.DUPLICATE_RESOURCE + "|rubric of another project",
        ),
    )
    judged = joined.withColumn("_fault", fault)
    rejects = reject_rows(
        judged.filter(F.col("_fault").isNotNull()),
        "submission_id",
        F.split("_fault", r"\|")[0],
        F.split("_fault", r"\|")[1],
        F.col("project_id"),
    )
    accepted = judged.filter(F.col("_fault").isNull()).select(*submissions.columns)
    return accepted, rejects


def resolve_idempotency(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """``outcome`` new, replay or conflict, and the ``existing_id`` a keyed request meets.

    A key already stored wins; otherwise the first request of the batch by
    ``(received_at, request_id)`` counts as stored for the later ones. The first per key is an
    aggregate with a map-side combine, so a key repeated without end stays one row.
    """
    fields = F.struct(*REQUEST_FIELDS)
    keyed = F.col("idempotency_key").isNotNull() & (F.col("idempotency_key") != "")
    first = (
        requests.filter(keyed)
        .groupBy("idempotency_key")
        .agg(
            F.min(
                F.struct("received_at", "request_id", fields.alias("fields"))
            ).alias("first")
        )
        .select(
            "idempotency_key",
            F.lit(1).alias("rank"),
            F.col("first.request_id").alias("id"),
            F.col("first.fields").alias("fields"),
        )
    )
    known = (
        stored.filter(keyed)
        .select(
            "idempotency_key",
            F.lit(0).alias("rank"),
            F.col("submission_id").alias("id"),
            fields.alias("fields"),
        )
        .unionByName(first)
        .groupBy("idempotency_key")
        .agg(F.min(F.struct("rank", "id", "fields")).alias("known"))
    )
    # requests without a key meet nothing, so they stay out of the join
    joined = requests.filter(keyed).join(known, "idempotency_key", "left")
    itself = (F.col("known.rank") == 1) & (F.col("known.id") == F.col("request_id"))
    same = F.lit(True)
    for name in REQUEST_FIELDS:
        same = same & F.col(name).eqNullSafe(F.col(f"known.fields.{name}"))
    outcome = (
        F.when(F.col("known").isNull() | itself, "new")
        .when(same, "replay")
        .otherwise("conflict")
    )
    existing = F.when(F.col("outcome") != "new", F.col("known.id"))
    met = (
        joined.withColumn("outcome", outcome)
        .withColumn("existing_id", existing)
        .select(*requests.columns, "outcome", "existing_id")
    )
    keyless = requests.filter(~F.coalesce(keyed, F.lit(False))).select(
        *requests.columns,
        F.lit("new").alias("outcome"),
        F.lit(None).cast(met.schema["existing_id"].dataType).alias("existing_id"),
    )
    return met.unionByName(keyless)


def reject_repeated_attempts(
    requests: DataFrame, stored: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``(project, group, attempt)`` must be new: not stored, and first of its kind here."""
    key = ["project_id", "group_id", "attempt_no"]
    taken = stored.select(*key).distinct().withColumn("_taken", F.lit(True))
    first = requests.groupBy(*key).agg(
        F.min(F.struct("received_at", "request_id")).alias("_first")
    )
    joined = requests.join(first.join(taken, key, "left"), key, "left")
    repeated = F.col("_taken").isNotNull() | (F.col("_first.request_id") != F.col("request_id"))
    rejects = reject_rows(
        joined.filter(repeated),
        "request_id",
        Code.DUPLICATE_RESOURCE,
        "attempt exists",
        F.concat_ws("/", *(F.col(k).cast("string") for k in key)),
    )
    return joined.filter(~repeated).select(*requests.columns), rejects


def latest_artifact(artifacts: DataFrame) -> DataFrame:
    """Highest version per (submission, kind); equal versions go to the greater sha256.

    The row travels with the choice, each column once, so leave out of ``artifacts`` what is not asked for.
    """
    key, order = ["submission_id", "kind"], ["version_no", "sha256"]
    rest = [c for c in artifacts.columns if c not in (*key, *order)]
    newest = F.max(F.struct(*order, *rest)).alias("a")
    return artifacts.groupBy(*key).agg(newest).select(*key, "a.*").select(*artifacts.columns)


#: What a submission keeps of a chosen artifact beside the version and hash that choose it.
ARTIFACT_FIELDS = ("artifact_id", "object_uri", "byte_size")


def ready_submissions(
    submissions: DataFrame, artifacts: DataFrame, keep: Sequence[str] = ARTIFACT_FIELDS
) -> tuple[DataFrame, DataFrame]:
    """Submissions with both artifacts, the latest of each; one aggregate and one join.

    Of an artifact, ``keep`` names what comes along with its version and hash; rows are sorted to find the latest,
    so the less the better. The rejects need to know only which kinds there are: flags, aggregated by hash.
    """
    report, source = (F.col("kind") == kind for kind in (REPORT, SOURCE))
    one = F.struct("version_no", "sha256", *keep)
    pairs = (
        artifacts.filter(report | source)
        .select("submission_id", report.alias("_report"), "version_no", "sha256", *keep)
        .groupBy("submission_id")
        .agg(
            F.max(F.when(F.col("_report"), one)).alias("report"),
            F.max(F.when(~F.col("_report"), one)).alias("source"),
        )
        .filter("report IS NOT NULL AND source IS NOT NULL")
    )
    kinds = artifacts.groupBy("submission_id").agg(F.max(report).alias("_report"), F.max(source).alias("_source"))
    lacks_report, lacks_source = (~F.coalesce(c, F.lit(False)) for c in ("_report", "_source"))
    rejects = reject_rows(
        submissions.join(kinds, "submission_id", "left").filter(lacks_report | lacks_source),
        "submission_id",
        Code.ARTIFACT_NOT_FOUND,
        "latest artifact missing",
        F.when(lacks_report, REPORT).otherwise(SOURCE),
    )
    return submissions.join(pairs, "submission_id"), rejects


def owned_artifacts(requests: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requested (submission, artifact, kind) triples that exist, and the others."""
    key = ["submission_id", "artifact_id", "kind"]
    rejects = reject_rows(
        requests.join(artifacts, key, "left_anti"),
        "submission_id",
        Code.ARTIFACT_NOT_FOUND,
        "artifact not owned",
        F.col("artifact_id"),
    )
    return requests.join(artifacts, key, "left_semi"), rejects


def list_artifacts(artifacts: DataFrame, segments: int | None = None) -> DataFrame:
    """``position`` of each artifact in its submission: kind, then newest version first. Hashes travel packed."""
    sha256 = ids.unpacked(F.col("sha256"))
    order = [F.col("kind"), F.col("version_no").desc(), sha256.desc()]
    slim = artifacts.withColumn("sha256", ids.packed(F.col("sha256")))
    return position_in_unit(slim, ["submission_id"], order, segments=segments).withColumn("sha256", sha256)


def audit_lineage(outputs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Outputs that name another artifact than their input, or another source hash."""
    registered = artifacts.select("artifact_id", F.col("sha256").alias("_registered"))
    fault = first_failure(
        (
            ~F.col("output_artifact_id").eqNullSafe(F.col("artifact_id")),
            Code.PARSER_ERROR + "|wrong artifact",
        ),
        (
            ~F.col("source_sha256").eqNullSafe(F.col("_registered")),
            Code.CONFLICT + "|source changed",
        ),
    )
    judged = outputs.join(registered, "artifact_id", "left").withColumn("_fault", fault)
    return reject_rows(
        judged.filter(F.col("_fault").isNotNull()),
        "artifact_id",
        F.split("_fault", r"\|")[0],
        F.split("_fault", r"\|")[1],
        F.col("output_artifact_id"),
    )


def ingest_faults(kind: str, max_bytes: int | None = None) -> Column:
    """The code of the first upload rule a measured file breaks."""
    suffix = F.lower(text.suffix(F.col("name")))
    return first_failure(
        (F.coalesce(F.col("name"), F.lit("")) == "", Code.BAD_REQUEST),
        (
            (suffix != UPLOAD_SUFFIX[kind])
            | ~F.coalesce(F.col("media_type").isin(*UPLOAD_MEDIA_TYPES[kind]), F.lit(False)),
            Code.UNSUPPORTED_MEDIA_TYPE,
        ),
        (F.col("byte_size") > (max_bytes or MAX_UPLOAD_BYTES[kind]), Code.PAYLOAD_TOO_LARGE),
        (F.col("byte_size") == 0, Code.BAD_REQUEST),
    )


def verify_artifact(
    artifacts: DataFrame, measured: DataFrame, max_bytes: dict[str, int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Declared size within the limit, then size and hash as measured, then the PDF signature.

    ``measured`` has ``(artifact_id, measured_size, measured_sha256, head)``, ``head`` being the
    first 1024 bytes; null where no signature is to be checked.
    """
    limits = max_bytes or MAX_UPLOAD_BYTES
    limit = F.when(F.col("kind") == REPORT, limits[REPORT]).otherwise(limits[SOURCE])
    head = F.regexp_replace(F.decode(F.col("head"), "ISO-8859-1"), r"^[\t\n\r\x0B\x0C ]+", "")
    fault = first_failure(
        (
            (F.col("byte_size") <= 0) | (F.col("byte_size") > limit),
            Code.PAYLOAD_TOO_LARGE + "|" + DECLARED_SIZE,
        ),
        (F.col("measured_size").isNull(), Code.STORAGE_ERROR + "|not measured"),
        (
            F.col("measured_size") > F.col("byte_size"),
            Code.PAYLOAD_TOO_LARGE + "|larger than declared",
        ),
        (
            (F.col("measured_size") != F.col("byte_size"))
            | (F.col("measured_sha256") != F.col("sha256")),
            Code.CONFLICT + "|checksum or size changed",
        ),
        (
            (F.col("kind") == REPORT) & ~head.startswith(PDF_SIGNATURE),
            Code.BAD_REQUEST + "|invalid PDF signature",
        ),
    )
    judged = artifacts.join(measured, "artifact_id", "left").withColumn("_fault", fault)
    rejects = reject_rows(
        judged.filter(F.col("_fault").isNotNull()),
        "artifact_id",
        F.split("_fault", r"\|")[0],
        F.split("_fault", r"\|")[1],
        F.col("measured_size"),
    )
    return judged.filter(F.col("_fault").isNull()).select(*artifacts.columns), rejects


def validate_object_uri(artifacts: DataFrame, folder: str, delivery: str) -> DataFrame:
    """``uri_ok``: the object lies in the folder of its own submission and kind."""
    uri = F.col("object_uri")
    pattern = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)/*([^?#]*)(\?[^#]*)?(#.*)?\z"
    path = F.regexp_extract(uri, pattern, 3)
    public_id = F.regexp_extract(path, r"(?s)^[^/]*/(.*)\z", 1)
    prefix = F.concat(
        F.lit(f"{folder}/submissions/"),
        F.col("submission_id").cast("string"),
        F.lit("/"),
        F.col("kind"),
        F.lit("/"),
    )
    ok = (
        (F.lower(F.regexp_extract(uri, pattern, 1)) == STORAGE_SCHEME)
        & (F.regexp_extract(uri, pattern, 2) == STORAGE_CLASS)
        & (F.split(path, "/")[0] == delivery)
        & public_id.startswith(prefix)
        & (F.char_length(public_id) > F.char_length(prefix))
        & (F.char_length(F.regexp_extract(uri, pattern, 4)) <= 1)
        & (F.char_length(F.regexp_extract(uri, pattern, 5)) <= 1)
        & ~F.exists(F.split(public_id, "/"), lambda p: p.isin(".", ".."))
    )
    return artifacts.withColumn("uri_ok", F.coalesce(ok, F.lit(False)))


def drop_bad_uris(artifacts: DataFrame, folder: str, delivery: str) -> tuple[DataFrame, DataFrame]:
    judged = validate_object_uri(artifacts, folder, delivery)
    rejects = reject_rows(
        judged.filter(~F.col("uri_ok")),
        "artifact_id",
        Code.STORAGE_ERROR,
        "invalid storage location",
        F.col("object_uri"),
    )
    return judged.filter("uri_ok").drop("uri_ok"), rejects

