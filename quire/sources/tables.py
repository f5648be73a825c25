"""Declared tables from parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.schemas import schema_of


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Scan a declared table with its fixed schema; nothing is inferred."""
    return spark.read.schema(schema_of(name)).parquet(f"{directory}/{name}")


def write_table(df: DataFrame, directory: str, name: str, mode: str = "append") -> None:
    """Write the declared columns of a table, absent ones as null."""
    from pyspark.sql import functions as F

    fields = schema_of(name).fields
    present = set(df.columns)
    columns = [
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in fields
    ]
    df.select(*columns).write.mode(mode).parquet(f"{directory}/{name}")
