"""Registered queries: a name, a Spark query and, where one exists, its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.ctes import query
from quire.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, so both engines return the same types."""
    whole = (T.ByteType, T.ShortType, T.IntegerType)
    return df.select(
        *(
            F.col(f.name).cast("bigint").alias(f.name)
            if isinstance(f.dataType, whole)
            else F.col(f.name)
            for f in df.schema.fields
        )
    )


def register(sql: str | None = None):
    """Register a query under its function's name, with its oracle when there is one."""

    def add(function: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, directory: str) -> DataFrame:
            return flat(function(tune(spark), directory))

        QUERIES[function.__name__] = run
        if sql:
            ORACLES[function.__name__] = query(sql)
        return function

    return add
