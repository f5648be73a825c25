"""Continuous intake: first request per key, ready submissions, and whole layout files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.submissions import REPORT, SOURCE
from quire.plans.report import audited_report_tables
from quire.session import materialize, scratch_scope
from quire.sources.layout import pages_of
from quire.sources.sinks import block_part, section_part
from quire.sources.store import KeyedTable, Part, Store


def stream_intake(requests: DataFrame, lateness: str) -> DataFrame:
    """Keep one request per idempotency key within the lateness bound; keyless rows pass.

    State is one entry per key and is dropped once the watermark has passed.
    """
    keyed = F.col("idempotency_key").isNotNull() & (F.col("idempotency_key") != "")
    first = (
        requests.filter(keyed)
        .withWatermark("received_at", lateness)
        .dropDuplicatesWithinWatermark(["idempotency_key"])
    )
    return first.unionByName(requests.filter(~keyed | keyed.isNull()))


def earliest_requests(spark: SparkSession, folder: str) -> KeyedTable:
    """One request per idempotency key, the earliest received (then of smallest id); every keyless one."""
    order = F.struct(-F.unix_micros(F.col("received_at")), -F.col("request_id"))
    return KeyedTable(spark, folder, "request_key", order)


def stream_earliest(
    requests: DataFrame, folder: str, checkpoint: str, **trigger: str | bool
) -> StreamingQuery:
    """Keep the earliest request of each key, however late it comes.

    ``requests`` has ``request_id`` (a number), ``received_at`` and ``idempotency_key``. Nothing is held in
    memory between batches and nothing is too late: ``earliest_requests`` reads the table.
    """
    key = F.col("idempotency_key")
    named = F.when(key != "", F.concat(F.lit("key:"), key))
    keyed = requests.withColumn("request_key", F.coalesce(named, F.concat(F.lit("request:"), "request_id")))

    def process(df: DataFrame, batch_id: int) -> None:
        earliest_requests(df.sparkSession, folder).merge(df, batch_id)

    return (
        keyed.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(process)
        .start()
    )


def newest_pairs(artifacts: DataFrame) -> DataFrame:
    """Latest report and source per submission; works on tables and on streams."""

    def newest(kind: str):
        one = F.struct("version_no", "registered_at")
        return F.max(F.when(F.col("kind") == kind, one))

    return artifacts.groupBy("submission_id").agg(
        newest(REPORT).alias("report"), newest(SOURCE).alias("source")
    )


def stream_ready(
    artifacts: DataFrame, folder: str, checkpoint: str, **trigger: str | bool
) -> StreamingQuery:
    """Maintain the latest pair of each submission, writing it whenever both exist.

    State is one row per submission. Updates are merged into a table that is compacted as it grows;
    ``ready_table`` reads the newest of each submission. ``trigger`` is that of the writer, all data at hand
    by default.
    """
    pairs = newest_pairs(artifacts).filter("report IS NOT NULL AND source IS NOT NULL")

    def process(df: DataFrame, batch_id: int) -> None:
        rows = df.withColumn("batch_id", F.lit(batch_id).cast("long"))
        _ready(df.sparkSession, folder).merge(rows, batch_id)

    return (
        pairs.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(process)
        .start()
    )


def _ready(spark: SparkSession, folder: str) -> KeyedTable:
    return KeyedTable(spark, folder, "submission_id", F.col("batch_id"))


def ready_table(spark: SparkSession, folder: str) -> DataFrame:
    return _ready(spark, folder).read().drop("batch_id")


def newest_files(texts: DataFrame) -> DataFrame:
    """One row per artifact, that of the latest ``modified_at``; of equal times the greater hash of the text.

    Times and hashes choose; texts stay in place, but for artifacts that come more than once.
    """
    hashed = texts.withColumn("_hash", F.xxhash64("value"))
    chosen = hashed.groupBy("artifact_id").agg(
        F.max(F.struct("modified_at", "_hash")).alias("_newest"), F.count(F.lit(1)).alias("_times")
    )
    met = hashed.join(chosen, "artifact_id").where(F.struct("modified_at", "_hash") == F.col("_newest"))
    columns = ["artifact_id", "value", "modified_at"]
    once, again = met.where("_times = 1").select(*columns), met.where("_times > 1").select(*columns)
    return once.unionByName(again.dropDuplicates(["artifact_id"]))


#: Runs of a stream's store after which they are merged, and seconds that merged ones are kept.
COMPACT_AFTER, RETAINED_S = 20, 86_400


def stream_layer1(
    texts: DataFrame, folder: str, checkpoint: str, parser_version: str, **trigger: str | bool
) -> StreamingQuery:
    """Document tables from layout files as they arrive, whole artifacts per micro-batch.

    ``texts`` is a stream of ``(artifact_id, value)``, one result file per row, with the file's time as
    ``modified_at`` where it is known. An artifact's newest file stands, whichever batch or order it comes in;
    ``delivered_table`` reads it. Runs are merged every ``COMPACT_AFTER`` batches. Scratch tables go when the
    batch is done.
    """
    if "modified_at" not in texts.columns:
        texts = texts.withColumn("modified_at", F.lit(None).cast("timestamp"))

    def process(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        store = Store(spark, folder)
        with scratch_scope(spark):
            files = materialize(newest_files(df))
            built = audited_report_tables(pages_of(files.drop("modified_at")))
            units = files.select("artifact_id", F.unix_millis("modified_at").alias("as_of"))
            rejects = built.rejects.withColumnRenamed("unit_id", "artifact_id")
            parts = [
                section_part(built.sections, units),
                block_part(built.blocks, parser_version, units),
                Part("rejects", rejects, "artifact_id", units),
            ]
            store.write_batch(parts, batch_id)
        if len(store.runs()) > COMPACT_AFTER:
            store.compact()
            store.vacuum(RETAINED_S)

    return (
        texts.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(process)
        .start()
    )


def delivered_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of a table that ``stream_layer1`` keeps, of each artifact's newest file."""
    return Store(spark, folder).read(name)
