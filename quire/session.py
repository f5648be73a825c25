"""Session helpers: where materialised intermediate tables go."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Let the adaptive planner split hot join keys even where that costs a further shuffle.

    Runtime settings only; sizes of partitions and executors stay the cluster's business.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate data; a new one only for local sessions."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_folder(spark: SparkSession) -> str:
    """A new sub-folder there, removed when its scope or else the driver ends."""
    folder = f"{shared_folder(spark)}/tables-{uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    if (made := _SCOPE.get()) is not None:
        made.append(folder)
    return folder


_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the scratch folders made within, for jobs that run again and again."""
    made: list[str] = []
    token = _SCOPE.set(made)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for folder in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: How tables are written whose rows may be of any size. Ids are digests in hexadecimal, which zstd halves; the default
#: codec keeps them whole. A row group is closed by its bytes before they are packed: a reader unpacks one group at a
#: time, and by Parquet's defaults (packed bytes, looked at after 100 rows) one of megabyte rows takes a gigabyte.
WRITE = {
    "compression": "zstd",
    "parquet.block.size": 16 << 20,
    "parquet.page.size": 32 << 20,  # above the group's, so that no page is packed before the group is full
    "parquet.page.size.row.check.min": 1,
    "parquet.page.size.row.check.max": 8,
}


def _write(df: DataFrame, table: str) -> None:
    df.write.options(**WRITE).parquet(table)


#: Bytes of a broadcast row for one byte of a written table, which the planner takes for equal: ids and names pack well.
UNPACKED = 8
_FACTOR = "spark.sql.sources.fileCompressionFactor"
_sized: dict[str, list] = {}
_sizing = Lock()


@contextmanager
def sized_by_rows(spark: SparkSession) -> Iterator[None]:
    """Let the planner take written tables for what they are unpacked, for jobs of many joins.

    A table that packs into the broadcast threshold may be rows of fifty times that, and the driver builds each broadcast.
    The session's own setting returns when the last of the jobs that run in it has ended; a larger one stays.
    """
    session = spark._jsparkSession.sessionUUID()
    with _sizing:
        held = _sized.setdefault(session, [0, spark.conf.get(_FACTOR, None)])
        held[0] += 1
        if held[0] == 1:
            spark.conf.set(_FACTOR, str(max(float(held[1] or 1), UNPACKED)))
    try:
        yield
    finally:
        with _sizing:
            held[0] -= 1
            if not held[0]:
                del _sized[session]
                if held[1] is None:
                    spark.conf.unset(_FACTOR)
                else:
                    spark.conf.set(_FACTOR, held[1])


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and continue from the written copy.

    Branches that follow read only the columns they need from it and repeat no work upstream,
    the planner knows its size, and a lost executor costs a re-read instead of a re-run.
    """
    table = f"{scratch_folder(df.sparkSession)}/rows"
    _write(df, table)
    return df.sparkSession.read.schema(df.schema).parquet(table)


def materialize_alone(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``build`` as a written table; the scratch tables made for it are removed."""
    table = f"{scratch_folder(spark)}/rows"
    with scratch_scope(spark):
        df = build()
        _write(df, table)
    return spark.read.schema(df.schema).parquet(table)
