"""Queries on copies of the tables in which one key holds a third of all rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.test_oracle import TABLES, in_order

SKEWED = {
    "lineitem": """
        SELECT CASE WHEN n % 3 = 0 THEN 1 ELSE l_orderkey END AS l_orderkey,
               CASE WHEN n % 3 = 1 THEN 7 ELSE l_partkey END AS l_partkey,
               * EXCLUDE (l_orderkey, l_partkey, n)
        FROM (SELECT *, row_number() OVER () AS n FROM lineitem_given)""",
    "orders": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey,
               * EXCLUDE (o_orderkey, o_custkey) FROM orders_given""",
    "events": """
        SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 5 ELSE user_id END AS user_id,
               * EXCLUDE (event_id, ts, user_id) FROM events_given""",
    "documents": """
        SELECT doc_id, CASE WHEN doc_id = 1 THEN
                 (SELECT string_agg(text, chr(10) ORDER BY doc_id) FROM documents_given
                  WHERE doc_id % 2 = 0) ELSE text END AS text, lang,
               CASE WHEN doc_id % 3 = 0 THEN 'src0' ELSE source END AS source, n_chars
        FROM documents_given""",
}
QUERIES = (
    "section_outline section_page_spans section_paths reading_order batch_section_text"
    " resolve_edges dedupe_edges canonical_edge_order admit_archives inventory_summary"
    " admit_submissions resolve_idempotency latest_artifact list_artifacts stream_ready"
).split()


@pytest.fixture(scope="module")
def skewed(sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    connection = duckdb.connect()
    connection.sql("SET TimeZone='UTC'")
    for name in TABLES:
        given = f"{sf_dir}/{name}.parquet"
        connection.sql(f"CREATE VIEW {name}_given AS SELECT * FROM '{given}'")
        body = SKEWED.get(name, f"SELECT * FROM {name}_given")
        connection.sql(f"COPY ({body}) TO '{folder}/{name}.parquet'")
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), connection


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_oracle_under_skew(spark, skewed, name):
    folder, connection = skewed
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    relation = connection.sql(entry.oracle_sql()[name])
    expected = relation.select(*[f'"{c}"' for c in columns]).fetchall()
    actual = [tuple(row) for row in df.select(*columns).collect()]
    assert in_order(actual) == in_order(expected)
