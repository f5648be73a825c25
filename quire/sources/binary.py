"""Uploaded files: measured, hashed and screened as ``binaryFile`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import base_name
from quire.operators.submissions import ingest_faults

SIGNATURE_BYTES = 1024
DEFAULT_MEDIA_TYPE = "application/octet-stream"


def ingest_binary(
    spark: SparkSession,
    path: str,
    kind: str,
    declared: DataFrame | None = None,
    media_type: str = DEFAULT_MEDIA_TYPE,
    max_bytes: int | None = None,
) -> DataFrame:
    """``path, name, byte_size, sha256, head, code`` of every file under ``path``.

    ``declared`` has ``(name, media_type)`` per uploaded file. The scan does not deliver empty
    files, so a declared name without a scanned file is one of size zero; without ``declared``
    every scanned file has ``media_type``. Files refused by name, type or size have no hash, and a
    query that needs only the checks leaves the content out of the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # Files are reduced to hash and head where they are read; no content meets a join.
    found = files.select(
        "path",
        base_name(F.col("path")).alias("name"),
        F.col("length").alias("_length"),
        F.sha2("content", 256).alias("_sha256"),
        F.substring("content", 1, SIGNATURE_BYTES).alias("_head"),
    )
    if declared is None:
        named = found.withColumn("media_type", F.lit(media_type))
    else:
        named = declared.join(found, "name", "left")
    checked = named.withColumn("byte_size", F.coalesce("_length", F.lit(0).cast("bigint")))
    return checked.withColumn("code", ingest_faults(kind, max_bytes)).select(
        "path",
        "name",
        "byte_size",
        F.when(F.col("code").isNull(), F.col("_sha256")).alias("sha256"),
        F.when(F.col("code").isNull(), F.col("_head")).alias("head"),
        "code",
    )
