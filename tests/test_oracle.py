"""Every registered query against DuckDB on the same tables, whole tables both sides."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    connection.sql("SET TimeZone='UTC'")
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def in_order(rows):
    return sorted(rows, key=lambda row: tuple((v is not None, str(v)) for v in row))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    relation = duck.sql(entry.oracle_sql()[name])
    assert columns == sorted(relation.columns)
    expected_types = dict(zip(relation.columns, map(str, relation.types)))
    for field in df.schema.fields:
        assert TYPES[field.dataType.simpleString()] == expected_types[field.name]
    actual = in_order(tuple(row) for row in df.select(*columns).collect())
    expected = in_order(relation.select(*[f'"{c}"' for c in columns]).fetchall())
    assert actual == expected
    assert actual or name.endswith("rejects")  # some faults do not occur in the smallest tables


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_oracle_has_rows(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
