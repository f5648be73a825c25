"""Streaming queries, run to completion over the files at hand and read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import register
from checks.report_queries import ocr_texts
from quire.session import materialize, scratch_folder
from quire.streaming import intake


def stream_of(spark, d, name):
    """A given table as a stream of its files."""
    schema = I.table(spark, d, name).schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    return files.parquet(d)


@register("""
    SELECT key AS idempotency_key, count(*) AS n
    FROM (SELECT DISTINCT 'k' || user_id || '-' || event_id % 40 AS key FROM events
          WHERE event_id % 3 <> 0) GROUP BY key
    UNION ALL
    SELECT NULL, count(*) FROM events WHERE event_id % 3 = 0""")
def stream_intake(spark, d):
    """Requests kept per key: one each, and every keyless one."""
    folder = scratch_folder(spark)
    requests = I.intake_rows(stream_of(spark, d, "events"))
    query = (
        intake.stream_intake(requests, "365 days")
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{folder}/kept")
    )
    query.awaitTermination()
    kept = spark.read.parquet(f"{folder}/kept")
    return kept.groupBy("idempotency_key").agg(F.count(F.lit(1)).alias("n"))


@register("""
    SELECT submission_id, max(version_no) FILTER (WHERE kind = 'report_pdf') AS report_version,
           max(version_no) FILTER (WHERE kind = 'source_archive') AS source_version
    FROM arrivals GROUP BY submission_id
    HAVING report_version IS NOT NULL AND source_version IS NOT NULL""")
def stream_ready(spark, d):
    folder = scratch_folder(spark)
    arrivals = I.arrival_rows(stream_of(spark, d, "events"))
    intake.stream_ready(arrivals, f"{folder}/ready", f"{folder}/checkpoint").awaitTermination()
    return intake.ready_table(spark, f"{folder}/ready").select(
        "submission_id",
        F.col("report.version_no").alias("report_version"),
        F.col("source.version_no").alias("source_version"),
    )


@register("""
    SELECT artifact_id::VARCHAR AS artifact_id, page_no, reading_order, content AS text_content,
           sha256(artifact_id || '|' || external_id) AS id
    FROM (SELECT artifact_id, page_no, reading_order, content, external_id FROM parsed
          UNION ALL
          SELECT artifact_id, page_no, reading_order, content, external_id FROM citations)""")
def stream_layer1(spark, d):
    """Layout files arriving in lots, every file twice; a second delivery replaces the first."""
    folder = scratch_folder(spark)
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = materialize(ocr_texts(spark, d))
    for _ in range(2):
        texts.repartition(files).write.mode("append").parquet(f"{folder}/arriving")
    arriving = (
        spark.readStream.schema("artifact_id BIGINT, value STRING")
        .option("maxFilesPerTrigger", max(1, files // 2))
        .parquet(f"{folder}/arriving")
    )
    intake.stream_layer1(
        arriving, f"{folder}/tables", f"{folder}/checkpoint", "layout-1"
    ).awaitTermination()
    return intake.delivered_table(spark, f"{folder}/tables", "document_blocks").select(
        "artifact_id", "page_no", "reading_order", "text_content", "id"
    )


@register("""
    SELECT event_id AS request_id, 'k' || user_id || '-' || event_id % 40 AS idempotency_key
    FROM events WHERE event_id % 3 <> 0
    QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY ts, event_id) = 1
    UNION ALL
    SELECT event_id, NULL FROM events WHERE event_id % 3 = 0""")
def stream_earliest(spark, d):
    """The earliest request of each key, although the latest arrive first and a lot arrives twice."""
    folder = scratch_folder(spark)
    events = I.table(spark, d, "events")
    lots = events.repartitionByRange(6, F.col("ts").desc())
    lots.write.parquet(f"{folder}/arriving")
    events.where("event_id % 4 = 1").coalesce(1).write.mode("append").parquet(f"{folder}/arriving")
    arriving = (
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/arriving")
    )
    intake.stream_earliest(I.intake_rows(arriving), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    kept = intake.earliest_requests(spark, f"{folder}/table").read()
    return kept.select("request_id", "idempotency_key")
