"""The registry of queries, and the SQL that several of them start from. Floats are rounded on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

H = """WITH b AS (SELECT event_type AS symbol, strftime(ts, '%Y-%m-%d') AS session, CAST(hour(ts) AS INT) AS bar_index, arg_min(value, ts) AS open,
 max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2, 3)"""
D = """WITH b AS (SELECT o_orderpriority AS symbol, strftime(o_orderdate, '%Y-%m-%d') AS session, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
 min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2)"""
W = "OVER (PARTITION BY symbol, session ORDER BY bar_index"
WD = "OVER (PARTITION BY symbol ORDER BY session"
#: Run ledger over hourly states.
RUNS = H + f""", s AS (SELECT *, CAST(sign(close - open) AS INT) AS state, lag(bar_index) {W}) AS lb, lag(CAST(sign(close - open) AS INT)) {W}) AS ls FROM b),
 f AS (SELECT *, sum(CASE WHEN coalesce(bar_index - lb <> 1, false) OR coalesce(state <> ls, false) THEN 1 ELSE 0 END) {W} ROWS UNBOUNDED PRECEDING) AS run FROM s),
 r0 AS (SELECT symbol, session, run, state, min(bar_index) AS s, max(bar_index) AS e, count(*) AS duration FROM f GROUP BY ALL),
 r AS (SELECT *, CASE WHEN lead(s) OVER (PARTITION BY symbol, session ORDER BY run) IS NULL THEN 'session_end' WHEN lead(s) OVER (PARTITION BY symbol, session ORDER BY run) - e > 1 THEN 'gap' ELSE 'exit' END AS ending FROM r0)"""

#: Bars that begin to rise inside their session.
EDGE_SQL = H + f", e AS (SELECT symbol, session, bar_index, close FROM (SELECT *, coalesce(lag(close > open) {W}), false) AS l FROM b) WHERE close > open AND NOT l)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")
