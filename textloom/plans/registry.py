"""How queries are named, and SQL pieces that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the DuckDB SQL of the same result if there is one."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def fixture(name: str, sql: str) -> None:
    """A query over literal rows: standard SQL that both engines run as it is."""
    QUERIES[name] = lambda spark, sf_dir: spark.sql(sql)
    ORACLE_SQL[name] = sql


D = "d AS (SELECT doc_id, text, lang, source, CASE doc_id % 10 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END AS \"set\" FROM documents)"
T = "t AS (SELECT conv_id, string_agg(chr(10) || chr(10) || rtrim(upper(trim(role)), '.') || '.' || chr(10) || text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"


def lines_sql(name: str, source: str, key: str) -> str:
    return f"{name} AS (SELECT {key}, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS text FROM (SELECT {key}, string_split(text, chr(10)) AS x FROM {source}))"


def chars_sql(name: str, source: str, key: str) -> str:
    return f"{name} AS (SELECT {key}, unnest(range(0, len(x))) AS pos, unnest(x) AS ch FROM (SELECT {key}, string_split(text, '') AS x FROM {source} WHERE text <> ''))"


def windows_sql(name: str, source: str, keys: str, width: int) -> str:
    """Cut into blocks first: substr walks from the start."""
    return f"""{name} AS (SELECT {keys}, b + j AS pos, substr(block, j + 1, {width}) AS piece FROM (
        SELECT {keys}, b, block, unnest(range(0, length(block) - {width - 1})) AS j FROM (
            SELECT {keys}, b, substr(text, b + 1, {256 + width - 1}) AS block FROM (
                SELECT {keys}, text, unnest(range(0, length(text) - {width - 1}, 256)) AS b FROM {source} WHERE length(text) >= {width}))))"""


def chunks_sql(name: str, source: str, key: str) -> str:
    """Chunks without look-ahead: a run of n spaces before a token is n-1 alone and one with it; elsewhere n-1 and the last."""
    return rf"""{name}_raw AS (SELECT {key}, unnest(range(0, len(x))) AS i, unnest(x) AS m FROM (
            SELECT {key}, regexp_extract_all(text, ' *(?:[\p{{L}}\p{{Nl}}\p{{No}}]|’)+| *\p{{Nd}}+| *[^\p{{L}}\p{{N}}\t\n\f\r ’]+|\n+| +') AS x FROM {source})),
        {name}_cut AS (SELECT {key}, i, m, length(m) - length(ltrim(m, ' ')) AS n, ltrim(m, ' ') AS rest FROM {name}_raw),
        {name} AS (SELECT {key}, chunk FROM (SELECT {key}, unnest(CASE
            WHEN n = 0 THEN [m] WHEN rest = '' AND n > 1 THEN [repeat(' ', n - 1), ' '] WHEN rest = '' THEN [m]
            WHEN n = 1 THEN [m] ELSE [repeat(' ', n - 1), ' ' || rest] END) AS chunk FROM {name}_cut))"""
