"""Prices of zero: the queries keep the infinities and the no-numbers of their SQL, apart from nulls."""

import math
import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline import catalogue
from strandline.functions.numbers import rounded
from strandline.operators import research
from strandline.plans import research as plans


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """Sessions in which many prices, some bars and one whole session are zero."""
    d, draw, rows = str(tmp_path_factory.mktemp("zero")), random.Random(5), []
    for day in range(8):
        for minute in range(0, 1440, 20):
            at = datetime(2024, 1, 1) + timedelta(days=day, minutes=minute)
            rows += [(len(rows) + k, at + timedelta(seconds=k), k, kind, 0.0 if day == 7 or draw.random() < 0.3 else round(draw.uniform(0, 300), 2), "{}") for k, kind in enumerate(("a", "b"))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    return d


def told(v):
    return v if not isinstance(v, float) else "no number" if math.isnan(v) else round(v, 6) + 0.0


@pytest.mark.parametrize("name", ["direction_targets", "checkpoint_outcomes", "entry_windows", "surprise_clusters", "opening_transition", "trajectory_features", "event_features"])
def test_zero_prices_equal_sql(spark, data, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{data}/events.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(told(r[c]) for c in columns) for r in df.collect()), key=repr)
    r = con.execute(catalogue.ORACLE_SQL[name])
    at = [[x[0] for x in r.description].index(c) for c in columns]
    assert got == sorted((tuple(told(x[i]) for i in at) for x in r.fetchall()), key=repr)
    assert any(v == "no number" or v in (math.inf, -math.inf) for row in got for v in row) or name == "opening_transition"


def test_halves_round_as_in_sql(spark):
    values = [98.99 / 32 - 1, 98.99 / 32, 0.1234565, 2.5e-06, -1.0000005, 1e9 + 0.0000005]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").orderBy("i").select(rounded(F.col("x"))).collect()]
    assert got == [duckdb.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in values]


def test_total_losses_are_told_as_minus_infinity(spark):
    nets = {"all lost": [0.1, -1.0, 0.1], "worn away": [-0.9] * 20, "more than all": [-1.5, 0.1], "kept": [0.25, -0.1]}
    rows = [(s, i, n, n, 1.0, 1.0) for s, ns in nets.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "symbol string, session int, gross double, net double, turnover double, position double")
    got = {r.symbol: told(r.net_return) for r in plans.told(research.measures(df, ["symbol"], ["session"])).collect()}
    log = lambda ns: duckdb.execute("select round(ln(1 + (exp(sum(ln(1 + x))) - 1)), 6) from unnest(?::double[]) t(x)", [ns]).fetchone()[0]
    assert got == {s: told(log(ns)) for s, ns in nets.items()} and got["worn away"] == -math.inf


def test_callbacks_round_their_prices_as_in_sql(spark, tmp_path):
    ids = [161552, 370669, 397409, 455614, 570119]
    ids += [r[0] for r in duckdb.execute("select i from range(6000000) t(i) where round(sin(i * 1.7) * 100, 4) = 0 and i > 0").fetchall()]
    rows = [(i, datetime(2024, 1, 2, 3), i % 7, "a", 1.0, "{}") for i in ids]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    df = catalogue.QUERIES["normalised_callbacks"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    names = ", ".join(f'"{c}"' for c in df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"select {names} from ({catalogue.ORACLE_SQL['normalised_callbacks']})").fetchall())


def test_summary_without_trades_or_losses_equals_sql(spark, tmp_path):
    """Flat prices (no trade), one rise (gains only), and ups and downs."""
    prices = {"flat": [1000.0] * 40, "rise": [1000.0 + 5000 * i for i in range(40)], "both": [1000.0 * (1 + i * i % 37) for i in range(60)], "one": [5.0]}
    rows = [(1000 * j + i, datetime(2020, 1, 1) + timedelta(days=i), s, p) for j, (s, ps) in enumerate(prices.items()) for i, p in enumerate(ps)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp_ntz, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    df = catalogue.QUERIES["backtest_summary"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    names = ", ".join(f'"{c}"' for c in df.columns)
    want = con.execute(f"select {names} from ({catalogue.ORACLE_SQL['backtest_summary']})").fetchall()
    assert sorted((tuple(map(told, r)) for r in df.collect()), key=repr) == sorted((tuple(map(told, r)) for r in want), key=repr)
