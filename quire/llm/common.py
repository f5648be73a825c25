"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a lookup table up to which it is broadcast; above, the same join is shuffled.
BROADCAST_ROWS = 100_000
#: Rows and bytes of an Arrow batch: texts can be long, so a batch holds few of them.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20
#: What Python workers remember of words, by the module that does, and how to forget it.
MEMORIES: dict[str, Callable[[], None]] = {}


@lru_cache(maxsize=None)
def _package() -> str:
    """This package as a zip file of the driver's, from where Spark hands it to Python workers."""
    top = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="package-")
    return shutil.make_archive(f"{folder}/quire", "zip", top, "quire")


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings: small Arrow batches, hot join keys split even above other shuffles, and this
    package shipped to the Python workers."""
    path = _package()
    if path not in spark.sparkContext._jsc.sc().addedFiles().toString():
        spark.sparkContext.addPyFile(path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def map_rows(
    df: DataFrame, rows: Callable[[Iterator[dict]], Iterator[dict]], schema: str
) -> DataFrame:
    """``df.mapInArrow`` for a function from column lists to column lists, one batch at a time.

    Workers live on from job to job: a task first forgets what other modules' tasks have left there, and gives
    freed memory back at its end.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in rows(batch.to_pydict() for batch in source):
            yield pa.RecordBatch.from_pydict({name: out[name] for name in names}, types)

    types = _arrow_schema(df.sparkSession, schema)
    return map_batches(df, batches, schema, rows.__module__)


def map_batches(
    df: DataFrame,
    batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
    module: str | None = None,
) -> DataFrame:
    """``df.mapInArrow`` with workers that keep no more memory than they need: see ``map_rows``."""
    owner = module or batches.__module__

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other, forget in MEMORIES.items():
            if other != owner:
                forget()
        release()
        try:
            yield from batches(source)
        finally:
            release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give memory that this worker has freed back to the system, where the platform lets it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of an array-valued expression that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def lookup_join(df: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a written or aggregated lookup table: broadcast when its counted rows are few, else shuffled."""
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(table) if small else table, on, how)


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def totals_before(lengths: Column, block: int = 64) -> Column:
    """Sum of the elements before each one of an integer array, block by block: far below n squared."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("bigint"), lambda a, b: a + b)

    def within(x: Column, starts: Column) -> Column:
        return F.transform(
            x,
            lambda _, i: F.get(starts, F.floor(i / block).cast("int"))
            + total(F.slice(x, (F.floor(i / block) * block + 1).cast("int"), i % block)),
        )

    def whole(x: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")),
            lambda b: total(F.slice(x, b * block + 1, block)),
        )
        return let(
            blocks,
            lambda sums: let(
                F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))), lambda starts: within(x, starts)
            ),
        )

    return let(F.transform(lengths, lambda v: v.cast("bigint")), whole)
