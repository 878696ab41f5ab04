"""Rows that come later change no feature: each is computed on all bars and on the bars up to a moment, and both agree there."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import features, inference, live, models, trajectories
from strandline.sources import bars

DATA = "/root/testdata/sf0.001"
S = ["symbol", "session"]

HOURLY = {
    # what is left of a session is known at its end only
    "session_clock": lambda b: features.session_clock(b).drop("remaining", "is_last", "missing"),
    "session_vwap": features.session_vwap,
    "relative_volume": features.relative_volume,
    "range_compression": features.range_compression,
    "symbol_features": trajectories.symbol_features,
    "bar_components": trajectories.bar_components,
    "pressure_slope": lambda b: trajectories.pressure_slope(b, 5),
    "new_extremes": lambda b: trajectories.new_extremes(b, 4),
    "activity_baseline": trajectories.activity_baseline,
    "robust_origins": lambda b: trajectories.robust_origins(b, S, "bar_index", ["close", "volume"], 4),
}
DAILY = {
    "regimes": features.regimes,
    "causal_rank": features.causal_rank,
    "ewm": features.ewm,
    "daily_features": features.daily_features,
    "market_context": trajectories.market_context,
    "change_points": lambda b: models.change_points(b.select("symbol", "session", "close", "volume"), ["symbol"], "session", "close", "volume", scale=10000.0, variance=1e8),
    "causal_forecasts": lambda b: live.causal_forecasts(b, ["symbol"], "session", "close", F.col("volume") < 4, 5.0),
    "month_choice": lambda b: inference.monthly_rule_choice(b.withColumn("session", F.substring("session", 1, 7)), "session", "symbol", "close", 3).drop("trades", "net"),
}


def known(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", sorted(HOURLY))
def test_later_bars_change_no_hourly_feature(spark, name):
    all_ = bars.hourly(spark, DATA).cache()
    past = (F.col("session") < "2024-01-20") | (F.col("session") == "2024-01-20") & (F.col("bar_index") <= 11)
    want, got = known(HOURLY[name](all_).where(past)), known(HOURLY[name](all_.where(past)).where(past))
    assert want == got and want


@pytest.mark.parametrize("name", sorted(DAILY))
def test_later_sessions_change_no_daily_feature(spark, name):
    all_ = bars.daily(spark, DATA).cache()
    want, got = known(DAILY[name](all_).where("session < '1997-03'")), known(DAILY[name](all_.where("session < '1997-03'")))
    assert want == got and want
