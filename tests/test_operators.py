"""Causality, sources, sinks and the operators that SQL does not express."""

import datetime

import pytest
from pyspark.sql import functions as F

from strandline import catalogue
from strandline.operators import backtest, events, features, options
from strandline.sources import bars, market_data

DATA = "/root/testdata/sf0.001"
CAUSAL = {
    "vwap": features.session_vwap, "relative": features.relative_volume, "levels": features.previous_session_levels, "compression": features.range_compression,
}


@pytest.mark.parametrize("name", list(CAUSAL))
def test_features_do_not_see_later_sessions(spark, name):
    b = bars.hourly(spark, DATA)
    cut = "2024-01-15"
    changed = b.withColumns({c: F.when(F.col("session") > cut, F.col(c) * 7 + 3).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume")})
    past = lambda df: sorted(map(tuple, CAUSAL[name](df).where(F.col("session") <= cut).collect()), key=repr)
    assert past(b) == past(changed)


def test_positions_do_not_see_later_rows(spark):
    b = bars.daily(spark, DATA)
    changed = b.withColumn("close", F.when(F.col("session") > "1997-01-01", F.col("close") * 3).otherwise(F.col("close")))
    past = lambda df: sorted(map(tuple, backtest.evaluated(backtest.sma(df)).where("session <= '1997-01-01'").collect()))
    assert past(b) == past(changed)


def test_hysteresis_holds_until_a_clear_switch(spark):
    p = [[0.9, 0.1], [0.45, 0.55], [0.3, 0.7], [0.55, 0.45]]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(p)], "k string, i int, p array<double>")
    assert [r.held for r in events.hysteresis(df, ["k"], "i").orderBy("i").collect()] == [0, 0, 1, 1]


def test_closures_are_canonical(spark):
    rows = [("s", "d", i, 1.0, 1.0, 1.0, 1.0 + x, 1.0) for i, x in enumerate([1, -1, 1, -1])]
    df = spark.createDataFrame(rows, "symbol string, session string, bar_index int, open double, high double, low double, close double, volume double")
    assert {r.loop for r in events.closures(df).collect()} == {"-1,1"}


def test_csv_to_store_and_back(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Date Time,O,H,L,Close,Vol\n2024-01-02T10:00:00+02:00,1,2,0.5,x,10\n2024-01-02 10:00:00,1,2,0.5,1.5,NaN\n")
    df = market_data.import_csv(spark, str(tmp_path / "x.csv"), "A", "s", "1h", "stock", timezone="America/New_York", mapping=market_data.parse_column_mapping("timestamp=Date Time"))
    rows = df.orderBy("timestamp").collect()
    assert [r.timestamp for r in rows] == [datetime.datetime(2024, 1, 2, 8), datetime.datetime(2024, 1, 2, 15)]
    assert rows[0].close is None and rows[1].volume is None
    market_data.write_dataset(df, str(tmp_path / "d"))
    back = market_data.load_dataset(spark, str(tmp_path / "d"), symbol="A")
    assert back.count() == 2 and market_data.dataset_metadata(back).first().rows == 2


def test_guard_refuses_anything_but_a_select():
    for bad in ("drop table x", "select 1; select 2", "select * from read_csv('x')", "select 1 -- x", "with a as (select 1) insert into b select * from a"):
        with pytest.raises(ValueError):
            market_data.check_select(bad)
    assert market_data.check_select("select 'drop; --' as x")


def test_vendor_rows_keep_the_last(spark):
    payload = '[{"date":"2024-01-01","close":1},{"date":"2024-01-01","close":2},{"timestamp":1704200000,"close":3}]'
    df = market_data.normalize_response(spark.createDataFrame([("A", payload)], "symbol string, payload string"))
    assert sorted(r.close for r in df.collect()) == [2.0, 3.0]


def test_window_scan_is_pushed_and_bounded(spark):
    with pytest.raises(ValueError):
        market_data.read_window(spark, f"{DATA}/events.parquet", ["value"], "ts", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")), F.to_timestamp_ntz(F.lit("2025-01-01 00:00:00")), 5)
    df = spark.read.parquet(f"{DATA}/events.parquet").where(F.col("ts") > F.to_timestamp_ntz(F.lit("2024-01-05 00:00:00"))).select("value")
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts" in df._jdf.queryExecution().toString()


def test_quote_rules(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (None, 1.0), (1.0, 1.1)], "b double, a double")
    assert [r[0] for r in df.select(options.quote_reason(F.col("b"), F.col("a"))).collect()] == ["wide", "crossed", "missing", None]


def test_every_part_gives_a_span(spark):
    rows = spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey", "p_brand", "p_retailprice").collect()
    want = sorted((p.p_partkey, s.p_partkey) for p in rows for s in rows if p.p_brand == s.p_brand and s.p_retailprice - 5 <= p.p_retailprice < s.p_retailprice + 5)
    got = sorted(map(tuple, catalogue.QUERIES["interval_join"](spark, DATA).collect()))
    assert got == want and {k for _, k in got} == {r.p_partkey for r in rows}
