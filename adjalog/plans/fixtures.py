"""Edge logs, property logs, key-value logs and traces over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The same definitions for both engines; ``floor`` because casts of doubles differ.
SQL = {
    "ops": "SELECT event_id AS seq, user_id AS src, CAST(floor(value) AS BIGINT) % 50 AS dst, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS op FROM events",
    "edges": "SELECT DISTINCT user_id AS src, CAST(floor(value) AS BIGINT) % 50 AS dst FROM events",
    "supply": "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem",
    "vprops": "SELECT event_id AS seq, user_id AS id, 'type' AS name, event_type AS value FROM events",
    "eprops": "SELECT event_id AS seq, user_id AS src, CAST(floor(value) AS BIGINT) % 50 AS dst, event_type AS name, props AS value FROM events",
    "kv": "SELECT event_id AS seq, user_id AS key, CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 7 < 3 THEN 2 ELSE 1 END AS op, CAST(floor(value) AS BIGINT) AS value, ts FROM events",
    "range_dels": "SELECT event_id AS seq, user_id AS lo, user_id + 10 AS hi FROM events WHERE event_id % 997 = 0",
    "entities": "SELECT c_custkey AS key, c_name AS base, c_mktsegment AS seg, c_nationkey AS nation FROM customer",
    "trace": "SELECT event_id, ts, event_type AS type, user_id AS key, length(props) AS value_size FROM events",
    "text_kv": "SELECT p_partkey AS seq, p_name AS key, p_brand AS value FROM part",
}
TABLES = {"events": ["ops", "edges", "vprops", "eprops", "kv", "range_dels", "trace"], "lineitem": ["supply"], "customer": ["entities"], "part": ["text_kv"]}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = next(t for t, names in TABLES.items() if name in names)
    return spark.sql(SQL[name].replace(f"FROM {source}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def with_sql(query: str, *names: str) -> str:
    """The query with fixtures as common table expressions."""
    return f"WITH {', '.join(f'{n} AS ({SQL[n]})' for n in names)} {query}" if names else query


__all__ = ["SQL", "fixture", "with_sql"]
