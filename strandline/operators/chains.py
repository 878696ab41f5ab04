"""Selections from option chains and the structures made of them. A chain has root, dte, strike, side (C or P), id, bid, ask, iv, oi, delta; each selection is one least struct a group, so no chain is sorted or paired."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.windows import six

KEY = ["root", "dte"]
LEG = ["id", "bid", "ask", "iv", "oi", "delta"]


def contract_multiplier(contract: Column, underlying: Column, strike: Column, sound: Column) -> Column:
    """100 for an unadjusted contract whose own text says its underlying and strike, else null."""
    pattern = r"^([A-Z]+)(\d{6})([CP])(\d{8})$"
    ok = sound & (F.regexp_extract(contract, pattern, 1) == F.upper(underlying)) & (F.abs(F.regexp_extract(contract, pattern, 4).try_cast("double") / 1000 - strike) < 1e-9)
    return F.when(F.coalesce(ok, F.lit(False)), 100)


def expiry_buckets(chain: DataFrame) -> DataFrame:
    """The nearest expiry in each bucket of days, or the reason why there is none."""
    buckets = {"0DTE": [0], "1DTE": [1], "3_5DTE": [3, 4, 5]}
    days = chain.groupBy("root").agg(F.array_sort(F.collect_set("dte")).alias("__d"))
    x = F.explode(F.array(*[F.struct(F.lit(n).alias("bucket"), F.array_min(F.array_intersect("__d", F.array(*[F.lit(k) for k in ks]))).alias("dte")) for n, ks in buckets.items()]))
    return days.select("root", x.alias("x")).select("root", "x.*").withColumn("reason", F.when(F.col("dte").isNull(), "no_expiry_in_bucket"))


def bounded_requests(chain: DataFrame, spot: float, steps: int) -> DataFrame:
    """The strikes of an expiry up to so many steps from the one at the money, both sides of each: never a whole chain."""
    s = chain.select(*KEY, "strike").distinct()
    w = Window.partitionBy(*KEY)
    s = s.withColumns({"__i": F.row_number().over(w.orderBy("strike")), "__near": F.min(F.struct(F.abs(F.col("strike") - spot), F.col("strike"))).over(w)["strike"]})
    s = s.withColumn("__at", F.max(F.when(F.col("strike") == F.col("__near"), F.col("__i"))).over(w)).where(F.abs(F.col("__i") - F.col("__at")) <= steps)
    return s.select(*KEY, "strike", F.explode(F.array(F.lit("C"), F.lit("P"))).alias("side"))


def pairs(chain: DataFrame) -> DataFrame:
    """Calls and puts of the same strike side by side: one pivot."""
    leg = F.struct(*LEG)
    side = lambda s: F.min(F.when(F.col("side") == s, leg))
    return chain.groupBy(*KEY, "strike").agg(side("C").alias("c"), side("P").alias("p")).where("c is not null and p is not null")


def relative_spread(*legs: str) -> Column:
    return reduce(Column.__add__, [F.col(f"{x}.ask") - F.col(f"{x}.bid") for x in legs]) / reduce(Column.__add__, [(F.col(f"{x}.ask") + F.col(f"{x}.bid")) / 2 for x in legs])


def atm_straddle(chain: DataFrame, spot: float, low: int, high: int) -> DataFrame:
    """The nearest expiry in a range of days that has common strikes; in it the pair next to the money, then by open interest, spread and difference of volatilities; and the first rule that one of its quotes fails."""
    p = pairs(chain).where(F.col("dte").between(low, high))
    p = p.withColumn("__first", F.min("dte").over(Window.partitionBy("root"))).where("dte = __first")
    rank = F.struct(F.round(F.abs(F.ln(F.col("strike") / spot)), 9), -F.least("c.oi", "p.oi"), F.round(relative_spread("c", "p"), 9), F.round(F.abs(F.col("c.iv") - F.col("p.iv")), 9), F.col("strike"), F.col("c.id"), F.col("p.id"))
    best = p.groupBy("root").agg(F.min_by(F.struct("dte", "strike", "c", "p"), rank).alias("b")).select("root", "b.*")
    bad = lambda x: (F.col(f"{x}.bid") <= 0) | (F.col(f"{x}.ask") < F.col(f"{x}.bid")) | (F.col(f"{x}.oi") <= 0)
    reason = F.when(bad("c"), "selected_call_quote").when(bad("p"), "selected_put_quote").when(~F.col("c.iv").between(0.005, 5.0), "selected_call_iv").when(~F.col("p.iv").between(0.005, 5.0), "selected_put_iv").otherwise("selected")
    return best.withColumn("reason", reason)


def primary_features(selected: DataFrame, spot: float) -> DataFrame:
    """What the selected pair says: volatility and its gap, the straddle and its share of the spot, spread, open interest, moneyness, and the straddle scaled to fifteen minutes."""
    mid = lambda x: (F.col(f"{x}.bid") + F.col(f"{x}.ask")) / 2
    straddle = mid("c") + mid("p")
    return selected.select("root", "dte", "strike", six((F.col("c.iv") + F.col("p.iv")) / 2).alias("atm_iv"), six(F.col("c.iv") - F.col("p.iv")).alias("iv_gap"), six(straddle).alias("straddle"), six(straddle / spot).alias("straddle_pct"), six(relative_spread("c", "p")).alias("spread"), (F.col("c.oi") + F.col("p.oi")).alias("oi"), six(F.ln(F.col("strike") / spot)).alias("moneyness"), six(straddle / spot * F.sqrt(15 / F.greatest(F.col("dte") * 390.0, F.lit(15.0)))).alias("move_15m"))


def nearest_delta(chain: DataFrame, side: str, target: float, most: float) -> DataFrame:
    """The contract of a side whose delta is nearest to a target, by group; null beyond the tolerance."""
    c = chain.where(F.col("side") == side)
    far = F.round(F.abs(F.col("delta") - target), 9)
    b = c.groupBy(*KEY).agg(F.min(F.struct(far.alias("d"), F.col("strike").alias("strike"), F.col("id").alias("id"), F.col("iv").alias("iv"))).alias("b"))
    return b.select(*KEY, F.when(F.col("b.d") <= most, F.col("b")).alias("b"))


def skew_and_term(chain: DataFrame, front: DataFrame, spot: float) -> DataFrame:
    """The volatility of the 25-delta put over the call's at the front expiry, and the back pair's over the front's; null where there is none."""
    f = front.select("root", "dte", six((F.col("c.iv") + F.col("p.iv")) / 2).alias("front_iv"))
    put, call = (nearest_delta(chain, s, t, 0.1).select(*KEY, F.col("b.iv").alias(n)) for s, t, n in (("P", -0.25, "put_iv"), ("C", 0.25, "call_iv")))
    back = atm_straddle(chain, spot, 46, 90).select("root", six((F.col("c.iv") + F.col("p.iv")) / 2).alias("back_iv"))
    j = f.join(put, KEY, "left").join(call, KEY, "left").join(back, "root", "left")
    return j.select("root", six(F.col("put_iv") - F.col("call_iv")).alias("skew"), six(F.col("back_iv") - F.col("front_iv")).alias("term"))


def surface(chain: DataFrame, spot: float, realised: Column) -> DataFrame:
    """The surface of each root in one pass: volatilities at, below and above the money, slope over expiries, open interest by side, and the volatility over what was realised."""
    near = F.abs(F.col("strike") - spot) <= 5
    avg = lambda c: six(F.avg(F.when(c, F.col("iv"))))
    g = chain.groupBy("root").agg(avg(near).alias("atm"), avg(F.col("strike") < spot - 5).alias("low"), avg(F.col("strike") > spot + 5).alias("high"), avg(F.col("dte") <= 5).alias("front"), avg(F.col("dte") > 5).alias("back"), F.sum(F.when(F.col("side") == "C", F.col("oi")).otherwise(0)).alias("call_oi"), F.sum(F.when(F.col("side") == "P", F.col("oi")).otherwise(0)).alias("put_oi"))
    return g.withColumns({"smile": six(F.col("low") + F.col("high") - 2 * F.col("atm")), "slope": six(F.col("back") - F.col("front")), "put_call": six(F.try_divide("put_oi", "call_oi")), "premium": six(F.col("atm") - realised)})


def mismatch(features: DataFrame, pairs_: dict[str, tuple[str, str]], scale: DataFrame) -> DataFrame:
    """Differences of standardised features: each less its frozen mean, over its frozen deviation."""
    one = features.withColumn("__one", F.lit(1)).join(F.broadcast(scale.withColumn("__one", F.lit(1))), "__one").drop("__one")
    z = lambda c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd")
    return one.withColumns({n: F.round(z(a) - z(b), 5) for n, (a, b) in pairs_.items()})


def debit_spreads(chain: DataFrame, low: int, high: int, tolerance: float = 0.2) -> DataFrame:
    """For each side of the nearest expiry in a range: a long leg near half a delta and a further short one near a quarter, by open interest, spread and error. The best short beyond each strike is carried along the strikes, so legs are not paired with all others."""
    c = chain.where(F.col("dte").between(low, high) & (F.col("bid") > 0) & (F.col("ask") >= F.col("bid")) & (F.col("oi") > 0))
    c = c.withColumn("__first", F.min("dte").over(Window.partitionBy("root"))).where("dte = __first").drop("__first")
    long, short = F.abs(F.abs("delta") - 0.5), F.abs(F.abs("delta") - 0.25)
    a = c.where(long <= tolerance).select("root", "dte", "side", F.struct("strike", *LEG).alias("long"), F.round(long, 9).alias("el"))
    b = c.where(short <= tolerance).select("root", "dte", "side", F.struct("strike", *LEG).alias("short"), F.round(short, 9).alias("es"))
    # an expiry's strikes near two deltas: tens of rows
    j = a.join(b, ["root", "dte", "side"]).where(F.when(F.col("side") == "C", F.col("short.strike") > F.col("long.strike")).otherwise(F.col("short.strike") < F.col("long.strike")))
    rank = F.struct(-F.least("long.oi", "short.oi"), F.round(relative_spread("long", "short"), 9), F.round(F.col("el") + F.col("es"), 9), F.col("long.id"), F.col("short.id"))
    return j.groupBy("root", "side").agg(F.min_by(F.struct("dte", F.col("long.id").alias("long_id"), F.col("short.id").alias("short_id"), six(F.col("long.ask") - F.col("short.bid")).alias("debit")), rank).alias("b")).select("root", "side", "b.*")


def position_pnl(legs: DataFrame, by: list[str], quantity: str, entry_bid: str, entry_ask: str, exit_bid: str, exit_ask: str, multiplier: float = 100.0, commission: float = 0.65) -> DataFrame:
    """Bought at the ask and sold at the bid, both ways, with a commission for each contract and side."""
    q = F.col(quantity)
    entry, exit_ = F.when(q > 0, F.col(entry_ask)).otherwise(F.col(entry_bid)), F.when(q > 0, F.col(exit_bid)).otherwise(F.col(exit_ask))
    return legs.groupBy(*by).agg(six(F.sum(q * entry * multiplier)).alias("cost"), six(F.sum(q * exit_ * multiplier)).alias("value"), six(F.sum(q * (exit_ - entry) * multiplier - 2 * F.abs(q) * commission)).alias("pnl"))


def contract_plan(chain: DataFrame, spot: float, steps: int, capacity: int) -> DataFrame:
    """Common strikes around the money of the nearest expiries, as many contracts as fit the capacity, the nearest first."""
    p = pairs(chain).select("root", "dte", "strike")
    w = Window.partitionBy("root", "dte").orderBy(F.abs(F.col("strike") - spot), "strike")
    p = p.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= 2 * steps + 1)
    n = F.row_number().over(Window.partitionBy("root").orderBy("dte", "__k"))
    return p.withColumn("rank", n).withColumn("planned", F.col("rank") * 2 <= capacity).drop("__k")


def shadow_outcomes(episodes: DataFrame, quotes: DataFrame, key: str, at: str, horizons: list[float], most_lag: float) -> DataFrame:
    """The first sound quote at or after each horizon, and how late it is; too late is missing. A forward as-of by the reversed time."""
    from strandline.operators.joins import asof

    t = episodes.withColumn("horizon", F.explode(F.array(*[F.lit(float(h)) for h in horizons]))).withColumn("back", -(F.col(at) + F.col("horizon")))
    q = quotes.withColumn("back", -F.col("t")).select(key, "back", "value")
    j = asof(t, q, [key], ["back"], ["value"])
    lag = -F.col("asof_back") + F.col("back")
    return j.select(*[c for c in episodes.columns], "horizon", F.when(lag <= most_lag, F.col("asof_value")).alias("value"), F.when(lag <= most_lag, F.round(lag, 3)).alias("lag"))


def structure_values(p: DataFrame, spot: float, exit_shift: float) -> DataFrame:
    """Five structures of each root's front expiry, entered at asks and left at bids: long call, put and straddle at the money, and both debit spreads to the next strikes. The exit quotes are the entry quotes moved."""
    w = Window.partitionBy("root").orderBy("strike")
    s = p.withColumn("__first", F.min("dte").over(Window.partitionBy("root"))).where("dte = __first")
    s = s.withColumns({"up": F.lead(F.struct("c", "strike")).over(w), "down": F.lag(F.struct("p", "strike")).over(w)})
    best = s.groupBy("root").agg(F.min_by(F.struct("c", "p", "up", "down", "strike"), F.struct(F.abs(F.col("strike") - spot), F.col("strike"))).alias("b")).select("root", "b.*")
    moved = lambda q, side: q + exit_shift if side == "C" else F.greatest(q - exit_shift, F.lit(0.0))
    longs = {"long_call": [("c", "C")], "long_put": [("p", "P")], "straddle": [("c", "C"), ("p", "P")]}
    rows = [F.struct(F.lit(n).alias("structure"), sum((F.col(f"{x}.ask") for x, _ in legs), F.lit(0.0)).alias("entry"), sum((moved(F.col(f"{x}.bid"), k) for x, k in legs), F.lit(0.0)).alias("exit")) for n, legs in longs.items()]
    for n, long, short, k in (("call_debit", "c", "up.c", "C"), ("put_debit", "p", "down.p", "P")):
        rows.append(F.struct(F.lit(n).alias("structure"), (F.col(f"{long}.ask") - F.col(f"{short}.bid")).alias("entry"), (moved(F.col(f"{long}.bid"), k) - moved(F.col(f"{short}.ask"), k)).alias("exit")))
    out = best.select("root", F.explode(F.array(*rows)).alias("x")).select("root", "x.*")
    return out.select("root", "structure", six(F.col("entry")).alias("entry"), six(F.col("exit")).alias("exit"), six(F.col("exit") - F.col("entry")).alias("pnl"))


def iron_butterfly(chain: DataFrame, spot: float, wing: float = 0.01) -> DataFrame:
    """Short pair at the money, and the nearest wings that are as far on both sides and at least a share of the spot away; or why there are none."""
    both = pairs(chain).select(*KEY, "strike")
    atm = both.groupBy(*KEY).agg(F.min(F.struct(F.abs(F.col("strike") - spot).alias("d"), F.col("strike").alias("atm"))).alias("x")).select(*KEY, "x.atm")
    legs = chain.select(*KEY, "strike", "side").distinct().join(F.broadcast(atm), KEY)
    away = F.when(F.col("side") == "C", F.col("strike") - F.col("atm")).otherwise(F.col("atm") - F.col("strike"))
    legs = legs.withColumn("away", away).where((F.col("away") > 0) & (F.col("away") + 1e-12 >= wing * spot))
    wings = legs.groupBy(*KEY, "away").agg(F.count_distinct("side").alias("sides")).where("sides = 2").groupBy(*KEY).agg(F.min("away").alias("width"))
    every = chain.select(*KEY).distinct().join(atm, KEY, "left").join(wings, KEY, "left")
    return every.withColumn("reason", F.when(F.col("atm").isNull(), "atm_pair_unavailable").when(F.col("width").isNull(), "symmetric_wings_unavailable").otherwise("available"))


def iron_condor(chain: DataFrame, most: float = 0.1) -> DataFrame:
    """Shorts nearest to a quarter delta and wings nearest to a tenth on both sides; refused if one is too far off or the strikes are out of order."""
    picks = {"short_call": ("C", 0.25), "short_put": ("P", -0.25), "long_call": ("C", 0.10), "long_put": ("P", -0.10)}
    parts = [nearest_delta(chain, s, t, 10.0).select(*KEY, F.col("b.strike").alias(n), F.col("b.d").alias(f"d_{n}")) for n, (s, t) in picks.items()]
    j = reduce(lambda a, b: a.join(b, KEY, "full_outer"), parts)
    far = reduce(Column.__or__, [F.col(f"d_{n}") > most for n in picks])
    gone = reduce(Column.__or__, [F.col(n).isNull() for n in picks])
    order = (F.col("long_put") < F.col("short_put")) & (F.col("short_put") < F.col("short_call")) & (F.col("short_call") < F.col("long_call"))
    reason = F.when(gone, "missing_greek").when(far, "delta_tolerance_failed").when(~order, "invalid_strike_ordering").when(F.col("long_call") - F.col("short_call") != F.col("short_put") - F.col("long_put"), "asymmetric_wings").otherwise("available")
    return j.select(*KEY, *picks, reason.alias("reason"))


def credit_spread(chain: DataFrame, side: str, spot: float, width: float = 0.01) -> DataFrame:
    """A short leg at the money and the nearest protective one further out."""
    c = chain.where(F.col("side") == side).select(*KEY, "strike").distinct()
    w = Window.partitionBy(*KEY)
    c = c.withColumn("short", F.min(F.struct(F.abs(F.col("strike") - spot), F.col("strike"))).over(w)["strike"])
    away = (F.col("strike") - F.col("short")) if side == "C" else (F.col("short") - F.col("strike"))
    g = c.withColumn("away", away).groupBy(*KEY, "short").agg(F.min(F.when((F.col("away") > 0) & (F.col("away") + 1e-12 >= width * spot), F.col("away"))).alias("width"))
    return g.withColumn("reason", F.when(F.col("width").isNull(), "protective_wing_unavailable").otherwise("available"))


def credit_shadow(chain: DataFrame, side: str, spot: float, exit_shift: float) -> DataFrame:
    """The credit spread's profit with conservative fills: the credit at the bid less the wing's ask, bought back at the ask less the wing's bid, with the most it could lose."""
    s = credit_spread(chain, side, spot).where("reason = 'available'")
    q = chain.where(F.col("side") == side).groupBy(*KEY, "strike").agg(F.min("bid").alias("bid"), F.max("ask").alias("ask"))
    wing = F.col("short") + F.col("width") if side == "C" else F.col("short") - F.col("width")
    j = s.withColumn("wing", wing).join(q.select(*KEY, F.col("strike").alias("short"), F.col("bid").alias("sb"), F.col("ask").alias("sa")), [*KEY, "short"]).join(q.select(*KEY, F.col("strike").alias("wing"), F.col("bid").alias("wb"), F.col("ask").alias("wa")), [*KEY, "wing"])
    credit, close = F.col("sb") - F.col("wa"), F.col("sa") + exit_shift - F.greatest(F.col("wb") + exit_shift, F.lit(0.0))
    return j.select(*KEY, "short", "wing", six(credit).alias("credit"), six(close).alias("close"), six(credit - close).alias("pnl"), six(F.col("width") - credit).alias("most_loss"))
