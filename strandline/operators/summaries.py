"""Summaries of bars, trades, splits, costs, events and paired policies; resampled and leave-out tables. One aggregate each, no loops."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.windows import expanding, islands, ordered, six


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is no whole."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def profit_factor(value: Column) -> Column:
    """Wins over losses: infinite without losses, 0 without either."""
    wins, losses = F.sum(F.greatest(value, F.lit(0.0))), F.sum(F.least(value, F.lit(0.0)))
    return F.when(losses < 0, wins / -losses).when(wins > 0, float("inf")).otherwise(0.0)


# bars


def volume_summary(bars: DataFrame, by: Sequence[str]) -> DataFrame:
    return bars.groupBy(*by).agg(F.count_if(F.col("volume").isNull()).alias("missing"), F.count_if(F.col("volume") == 0).alias("zero"), F.min("volume").alias("low"), F.max("volume").alias("high"), six(F.avg("volume")).alias("mean"))


def adjusted_summary(rows: DataFrame, by: Sequence[str], close: str, adjusted: str, time: str) -> DataFrame:
    """Where an adjusted price differs from the price: how often, by how much at most, first and last time."""
    ratio = F.try_divide(F.abs(F.col(adjusted) - F.col(close)), F.abs(F.col(close)))
    changed = F.coalesce(ratio > 0.000001, F.lit(False))
    return rows.groupBy(*by).agg(F.count_if(F.col(adjusted).isNull()).alias("missing"), F.count_if(changed).alias("different"), six(F.coalesce(F.max(ratio), F.lit(0.0))).alias("largest"), F.min(F.when(changed, F.col(time))).alias("first"), F.max(F.when(changed, F.col(time))).alias("last"))


def baseline_summary(bars: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """First and last close, total, mean, volatility, hit rate, Sharpe and drawdown of the closes themselves."""
    w = ordered(by, order)
    r = bars.withColumn("__r", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).withColumn("__first", F.first("close").over(expanding(by, order)))
    r = r.withColumn("__down", F.when(F.col("__r").isNotNull(), F.col("close") / F.max(F.when(F.col("__r").isNotNull(), F.col("close"))).over(expanding(by, order)) - 1))
    order_key = F.struct(*order)
    sd = F.stddev_samp("__r")
    return r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.min_by("close", order_key).alias("close_start"), F.max_by("close", order_key).alias("close_end"), six(F.max_by("close", order_key) / F.min_by("close", order_key) - 1).alias("total_return"), six(F.avg("__r")).alias("mean_return"),
        F.round(sd, 5).alias("volatility"), six(F.avg((F.col("__r") > 0).cast("double"))).alias("hit_rate"), F.round(F.when(sd > 0, F.avg("__r") / sd * 252**0.5).otherwise(0.0), 5).alias("sharpe"), six(F.min("__down")).alias("max_drawdown"),
    )


def bar_summary(bars: DataFrame, by: Sequence[str], order: Column) -> DataFrame:
    """Rows, first and last close, range, mean and total volume of bounded bars."""
    return bars.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), F.min_by("close", order).alias("first_close"), F.max_by("close", order).alias("latest_close"), F.min("close").alias("min_close"), F.max("close").alias("max_close"), six(F.avg("close")).alias("average_close"), F.sum("volume").alias("total_volume"))


def recent_sessions(bars: DataFrame, limit: int = 20) -> DataFrame:
    """The last sessions of each symbol, one row each."""
    s = bars.groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("bar_count"), F.min_by("close", "bar_index").alias("first_close"), F.max_by("close", "bar_index").alias("latest_close"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"))
    return s.withColumn("__k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("session")))).where(F.col("__k") <= limit).drop("__k")


# universes and runs


def universe_health(universe: DataFrame, datasets: DataFrame, key: str, rows: str, first: str, last: str) -> DataFrame:
    """Coverage of a universe: how many symbols have data, their mean rows and the span."""
    j = universe.select(key).distinct().join(datasets, key, "left")
    return j.agg(F.count(F.lit(1)).alias("total_symbols"), F.count(rows).alias("datasets_present"), F.count_if(F.col(rows).isNull()).alias("datasets_missing"), six(F.coalesce(F.avg(rows), F.lit(0.0))).alias("average_rows"), F.min(first).alias("first"), F.max(last).alias("last"))


def reason_counts(rows: DataFrame, reasons: str, limit: int = 20) -> DataFrame:
    """How often each reason is given, the most common first."""
    return rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(limit)


def failure_anatomy(reports: DataFrame, payload: str) -> DataFrame:
    """JSON run reports by classification: how many, how many reasons, their mean net return; what cannot be read is its own class."""
    r = reports.select(F.from_json(payload, "classification string, classification_reasons array<string>, net_return double").alias("r"))
    name = F.coalesce(F.col("r.classification"), F.lit("malformed"))
    return r.groupBy(name.alias("classification")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.size(F.coalesce("r.classification_reasons", F.array().cast("array<string>"))), F.lit(0))).cast("long").alias("reasons"), six(F.avg("r.net_return")).alias("mean_net_return"))


def compare_runs(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """Classification counts of two runs and their difference, and how many symbols came and went."""
    j = a.select(key, F.col(label).alias("a")).join(b.select(key, F.col(label).alias("b")), key, "full_outer")
    side = j.select(F.explode(F.array_compact(F.array(F.when(F.col("a").isNotNull(), F.struct(F.col("a").alias("l"), F.lit(1).alias("x"), F.lit(0).alias("y"), F.col("b").isNull().cast("int").alias("gone"), F.lit(0).alias("came"))), F.when(F.col("b").isNotNull(), F.struct(F.col("b").alias("l"), F.lit(0).alias("x"), F.lit(1).alias("y"), F.lit(0).alias("gone"), F.col("a").isNull().cast("int").alias("came")))))).alias("s")).select("s.*")
    return side.groupBy(F.col("l").alias(label)).agg(F.sum("x").alias("n_a"), F.sum("y").alias("n_b"), (F.sum("y") - F.sum("x")).alias("delta"), F.sum("gone").alias("removed"), F.sum("came").alias("added"))


def feature_buckets(trades: DataFrame, feature: str, value: str) -> DataFrame:
    """Trades by the value of a feature (null: unknown): how many, their mean, the largest bucket first."""
    return trades.groupBy(F.coalesce(F.col(feature), F.lit("unknown")).alias("bucket")).agg(F.count(F.lit(1)).alias("trade_count"), six(F.avg(value)).alias("average_net_return")).orderBy(F.desc("trade_count"), "bucket")


# trades, splits, costs


def trade_summary(trades: DataFrame, by: list[str], value: str, order: list[str], tops: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Count, mean, median, win rate, profit factor, what the largest winners and losers hold, and the longest run of losses."""
    t = trades.where(F.col(value).isNotNull()).select(*by, *order, F.col(value).cast("double").alias("v"))
    w = Window.partitionBy(*by)
    t = t.withColumns({"__up": F.row_number().over(w.orderBy(F.desc("v"), *order)), "__down": F.row_number().over(w.orderBy("v", *order)), "__loss": F.col("v") < 0})
    t = t.withColumn("__run", islands(F.col("__loss") != F.lag("__loss").over(ordered(by, order)), by, order))
    streaks = t.where("__loss").groupBy(*by, "__run").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.max("n").alias("streak"))
    best = lambda k: F.sum(F.when((F.col("__up") <= k) & (F.col("v") > 0), F.col("v")).otherwise(0.0))
    worst = F.sum(F.when((F.col("__down") <= 5) & (F.col("v") < 0), F.col("v")).otherwise(0.0))
    positive, negative, total = F.sum(F.greatest("v", F.lit(0.0))), F.sum(F.least("v", F.lit(0.0))), F.sum("v")
    g = t.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), six(F.avg("v")).alias("mean"), six(F.percentile("v", F.lit(0.5))).alias("median"), six(F.avg((F.col("v") > 0).cast("double"))).alias("win_rate"), six(profit_factor(F.col("v"))).alias("profit_factor"),
        six(share(best(5), total)).alias("top5_share_of_net"), six(share(F.abs(worst), F.abs(negative))).alias("top5_losers_share"), *[six(share(best(k), positive)).alias(f"top{k}_share_of_profit") for k in tops],
    )
    return g.join(streaks, by, "left").withColumn("longest_losing_streak", F.coalesce("streak", F.lit(0))).drop("streak")


def split_summary(rows: DataFrame, by: list[str], split: str, value: str) -> DataFrame:
    """Splits: positive ones, best and worst, and what the best holds of all that is positive."""
    v = F.coalesce(F.col(value), F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("splits"), F.count_if(v > 0).alias("positive"), six(F.avg((v > 0).cast("double"))).alias("profitable_share"), F.max_by(split, F.struct(v, -F.col(split))).alias("best_split"), six(F.max(v)).alias("best"), F.min_by(split, F.struct(v, F.col(split))).alias("worst_split"), six(F.min(v)).alias("worst"),
        six(share(F.greatest(F.max(v), F.lit(0.0)), F.sum(F.greatest(v, F.lit(0.0))))).alias("top_share"),
    )


def cost_stress(rows: DataFrame, by: list[str], multiplier: str, net: str) -> DataFrame:
    """The first cost multiplier at which the net is gone, and whether one and a half times the cost is survived."""
    m = F.col(multiplier)
    return rows.groupBy(*by).agg(F.min(F.when((m > 0) & (F.col(net) <= 0), m)).alias("first_nonpositive"), F.coalesce(F.bool_or((F.abs(m - 1.5) < 1e-9) & (F.col(net) > 0)), F.lit(False)).alias("survives_1_5x"))


def event_responses(events: DataFrame, state: str, horizons: Sequence[int], most_symbol: float = 0.5, most_session: float = 0.2) -> DataFrame:
    """Forward responses by state and horizon: location, spread, excursions, and how much one symbol or one session holds. Columns fwd_h, mfe_h, mae_h."""
    e = events.select(state, "symbol", "session", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("r"), F.col(f"mfe_{h}").alias("mfe"), F.col(f"mae_{h}").alias("mae")) for h in horizons])).alias("x")).select(state, "symbol", "session", "x.*").where("r is not null")
    by = [state, "horizon"]
    per = lambda *keys: e.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("c")).groupBy(*by).agg(F.max("c").alias("most"), F.count(F.lit(1)).alias("groups"))
    half = lambda c: six(F.percentile(c, F.lit(0.5)))
    g = e.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"), half("r").alias("median_return"), six(F.avg("r")).alias("mean_return"), six(F.avg((F.col("r") > 0).cast("double"))).alias("win_rate"), half("mfe").alias("median_mfe"), half("mae").alias("median_mae"), half(F.abs("r")).alias("median_abs"), six(F.percentile("r", F.lit(0.25))).alias("p25"), six(F.percentile("r", F.lit(0.75))).alias("p75"),
    )
    symbols, sessions = per("symbol").select(*by, F.col("most").alias("__s"), F.col("groups").alias("symbols")), per("symbol", "session").select(*by, F.col("most").alias("__d"), F.col("groups").alias("sessions"))
    j = g.join(symbols, by).join(sessions, by).withColumns({"symbol_share": six(F.col("__s") / F.col("events")), "session_share": six(F.col("__d") / F.col("events"))}).drop("__s", "__d")
    return j.withColumn("concentrated", (F.col("symbol_share") > most_symbol) | (F.col("session_share") > most_session))


def settled_before(trades: DataFrame, settlement: str, decision: Column) -> DataFrame:
    """Outcomes that are fully known strictly before a decision."""
    return trades.where(F.col(settlement) < decision)


def stock_contributions(fills: DataFrame, cell: list[str], stock: str, net: str, cost: str, cap: float, tail: float = 0.1) -> DataFrame:
    """Fills to one capped contribution a stock, then the winsorised mean and the median across stocks of a cell; gross is the capped net plus the cost."""
    s = fills.groupBy(*cell, stock).agg(F.greatest(F.least(F.round(F.avg(net), 9), F.lit(cap)), F.lit(-cap)).alias("n"), F.round(F.avg(cost), 9).alias("c"), F.count(F.lit(1)).alias("fills"))
    s = s.withColumn("g", F.col("n") + F.col("c"))
    w = Window.partitionBy(*cell)
    for x in ("n", "g"):
        s = s.withColumns({f"__lo{x}": F.percentile(x, F.lit(tail)).over(w), f"__hi{x}": F.percentile(x, F.lit(1 - tail)).over(w)})
    mean = lambda x: F.round(F.avg(F.greatest(F.least(F.col(x), F.col(f"__hi{x}")), F.col(f"__lo{x}"))), 6)
    return s.groupBy(*cell).agg(F.count(F.lit(1)).alias("stocks"), F.sum("fills").alias("fills"), mean("g").alias("robust_gross"), six(F.sum("c")).alias("total_cost"), mean("n").alias("robust_net"), six(F.percentile("n", F.lit(0.5))).alias("median_net"), F.array_join(F.array_sort(F.collect_set(F.col(stock).cast("string"))), "|").alias("ids"))


def payoff_components(panel: DataFrame, session: list[str], regime: str, value: str) -> DataFrame:
    """value = common (the session's median) + regime (the regime's median of what is left) + rest."""
    p = panel.withColumn("common", F.percentile(value, F.lit(0.5)).over(Window.partitionBy(*session)))
    p = p.withColumn("regime_part", F.percentile(F.col(value) - F.col("common"), F.lit(0.5)).over(Window.partitionBy(*session, regime)))
    return p.withColumn("rest", F.col(value) - F.col("common") - F.col("regime_part"))


def four_way(rows: DataFrame, a: Column, b: Column, value: str, session: str, stock: str) -> DataFrame:
    """The table of two yes-no conditions: 1 both, 2 only the first, 3 only the second, 4 neither."""
    cell = F.when(a & b, "1").when(a, "2").when(b, "3").otherwise("4")
    return rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(session).alias("sessions"), F.count_distinct(stock).alias("stocks"), six(F.avg(value)).alias("mean"), six(F.percentile(value, F.lit(0.5))).alias("median"), six(F.avg((F.col(value) > 0).cast("double"))).alias("positive_rate"))


def interaction(rows: DataFrame, by: list[str], a: Column, b: Column, gross: str, net: str, cost: str) -> DataFrame:
    """The 2 x 2 cells of two gates by group, and the contrast (both + neither - either) of their mean nets."""
    named = F.concat(F.when(a, "pass").otherwise("fail"), F.lit("|"), F.when(b, "pass").otherwise("fail"))
    g = rows.groupBy(*by, named.alias("cell")).agg(F.count(F.lit(1)).alias("n"), six(F.sum(gross)).alias("gross"), six(F.sum(net)).alias("net"), F.avg(net).alias("mean"), six(F.percentile(net, F.lit(0.5))).alias("median"), six(F.sum(cost)).alias("cost"), six(F.sum(F.col(gross) - 2 * F.col(cost))).alias("twice_cost_net"))
    sign = F.when(F.col("cell").isin("pass|pass", "fail|fail"), F.col("mean")).otherwise(-F.col("mean"))
    return g.withColumn("contrast", six(F.sum(sign).over(Window.partitionBy(*by)))).withColumn("mean", six(F.col("mean")))


def veto_accounting(rows: DataFrame, by: list[str], admitted: Column, net: str) -> DataFrame:
    """Losses that a veto avoids less the profits it rejects, on one population."""
    lost, won = ~admitted & (F.col(net) < 0), ~admitted & (F.col(net) > 0)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col(net))), F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("opportunities"), F.count_if(admitted).alias("admitted"), F.count_if(lost).alias("losers_rejected"), F.count_if(won).alias("winners_rejected"), six(-total(lost)).alias("losses_avoided"), six(total(won)).alias("profits_rejected"), six(-total(lost) - total(won)).alias("veto_value"), six(total(admitted)).alias("retained"), six(F.avg(admitted.cast("double"))).alias("coverage"),
    )


def paired_differences(rows: DataFrame, keys: list[str], variant: str, value: str, treatment: str, control: str) -> DataFrame:
    """Both variants of each opportunity and their difference; refuses populations that differ. One pass: a pivot, not a join."""
    pick = lambda v: F.max(F.when(F.col(variant) == v, F.col(value)))
    number = lambda v: F.count_if(F.col(variant) == v)
    g = rows.where(F.col(variant).isin(treatment, control)).groupBy(*keys).agg(pick(treatment).alias("treatment"), pick(control).alias("control"), number(treatment).alias("__t"), number(control).alias("__c"))
    sound = F.raise_error(F.lit("paired populations differ")).cast("double")
    return g.select(*keys, "treatment", "control", F.when((F.col("__t") == 1) & (F.col("__c") == 1), F.col("treatment") - F.col("control")).otherwise(sound).alias("difference"))


def slices(rows: DataFrame, dimensions: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """The measures over all rows and over each value of each dimension: each row is dealt to its slices once."""
    parts = F.array(F.struct(F.lit("all").alias("slice"), F.lit("all").alias("value")), *[F.struct(F.lit(d).alias("slice"), F.col(d).cast("string").alias("value")) for d in dimensions])
    return rows.withColumn("__s", F.explode(parts)).groupBy("__s.slice", "__s.value").agg(*[c.alias(n) for n, c in measures.items()])


def without_top(rows: DataFrame, dimension: str, value: str, top: int) -> DataFrame:
    """Count, total and mean without the groups that contribute most: from group sums, not from rows again."""
    g = rows.groupBy(dimension).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    best = g.orderBy(F.desc(F.round("s", 6)), dimension).limit(top)
    rest = g.join(F.broadcast(best.select(dimension)), dimension, "left_anti")
    return rest.agg(F.sum("n").alias("remaining"), F.round(F.sum("s"), 4).alias("total"), six(F.sum("s") / F.sum("n")).alias("mean"))


def deletion_metrics(rows: DataFrame, by: list[str], left_out: str, value: str) -> DataFrame:
    """Rows and mean of a group without each member: total less part."""
    g = rows.groupBy(*by, left_out).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    w = Window.partitionBy(*by)
    n, mean = F.sum("n").over(w) - F.col("n"), F.try_divide(F.sum("s").over(w) - F.col("s"), F.sum("n").over(w) - F.col("n"))
    return g.select(*by, left_out, n.alias("rows"), six(mean).alias("mean"), (mean > 0).alias("positive"))


def weighted_quantiles(rows: DataFrame, by: list[str], value: str, weight: str, qs: dict[str, float]) -> DataFrame:
    """Several quantiles at once: positions (cumulative weight - w/2) / total over equal values together, linear between, clamped at the ends."""
    g = rows.groupBy(*by, F.col(value).alias("v")).agg(F.sum(weight).alias("w")).where("w > 0")
    w = Window.partitionBy(*by).orderBy("v")
    g = g.withColumn("p", (F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("w") / 2) / F.sum("w").over(Window.partitionBy(*by)))
    g = g.withColumns({"pv": F.lag("v").over(w), "pp": F.lag("p").over(w), "nv": F.lead("v").over(w)})
    at = lambda q: F.when((F.col("p") >= q) & F.col("pp").isNull(), F.col("v")).when((F.col("p") >= q) & (F.col("pp") < q), F.col("pv") + (F.col("v") - F.col("pv")) * (q - F.col("pp")) / (F.col("p") - F.col("pp"))).when((F.col("p") < q) & F.col("nv").isNull(), F.col("v"))
    return g.groupBy(*by).agg(*[six(F.max(at(q))).alias(n) for n, q in qs.items()])


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def tail_metrics(rows: DataFrame, by: list[str], weight: str, movement: str, residual: str, expected: str, session: str, stock: str, order: str) -> DataFrame:
    """Weighted surface of a selected tail: means, residual quantiles, the trimmed mean, what the top twentieth adds, and how much one stock or session holds."""
    w, n = Window.partitionBy(*by), F.count(F.lit(1)).over(Window.partitionBy(*by))
    r = rows.withColumns({"__k": F.row_number().over(w.orderBy(residual, order)), "__n": n})
    wt, res = F.col(weight), F.col(residual)
    trim = F.floor(F.col("__n") * 0.1)
    kept = (F.col("__k") > trim) & (F.col("__k") <= F.col("__n") - trim)
    top = F.col("__k") > F.col("__n") - F.greatest(F.lit(1), F.ceil(F.col("__n") * 0.05))
    positive = F.greatest(res, F.lit(0.0))
    g = r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(session).alias("sessions"), F.count_distinct(stock).alias("stocks"), six(weighted_mean(F.col(movement), wt)).alias("mean_movement"), six(weighted_mean(F.col(expected), wt)).alias("mean_expected"), six(weighted_mean(res, wt)).alias("mean_residual"),
        six(F.try_divide(F.sum(F.when(kept, wt * res)), F.sum(F.when(kept, wt)))).alias("trimmed_residual"), six(weighted_mean((res > 0).cast("double"), wt)).alias("positive_rate"), six(F.try_divide(F.sum(F.when(top, wt * positive)), F.sum(wt * positive))).alias("top_share"),
    )
    quantiles = weighted_quantiles(rows, by, residual, weight, {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    most = lambda c: rows.groupBy(*by, c).agg(F.count(F.lit(1)).alias("__c")).groupBy(*by).agg(six(F.max("__c") / F.sum("__c")).alias(f"most_{c}"))
    return reduce(lambda a, b: a.join(b, by), [quantiles, most(stock), most(session)], g)


# distributions


def poisson_binomial(rows: DataFrame, by: list[str], order: str, p: str) -> DataFrame:
    """How many of a group's independent events happen: exact probabilities by folding one event after another."""
    g = rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, p))), lambda x: x[p]).alias("ps"))
    step = lambda d, q: F.transform(F.sequence(F.lit(0), F.size(d)), lambda k: F.coalesce(F.get(d, k), F.lit(0.0)) * (1 - q) + F.when(k > 0, F.get(d, k - 1) * q).otherwise(0.0))
    return g.select(*by, F.aggregate("ps", F.array(F.lit(1.0)), step).alias("distribution"))


def convolved(a: Column, b: Column) -> Column:
    """The convolution of two arrays."""
    return F.transform(F.sequence(F.lit(0), F.size(a) + F.size(b) - 2), lambda k: F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), F.lit(0.0), lambda s, i: s + F.get(a, i) * F.when((k >= i) & (k - i < F.size(b)), F.get(b, k - i)).otherwise(0.0)))


def durations_within(first: Column, second: Column, horizon: int) -> Column:
    """The chance of finishing two stages in exactly 1..horizon steps (first[i], second[i]: the chance of i + 1 steps)."""
    whole = convolved(F.concat(F.array(F.lit(0.0)), first), F.concat(F.array(F.lit(0.0)), second))
    return F.slice(whole, F.lit(2), F.lit(horizon))


def small_counts(events: DataFrame, by: list[str], month: str, stock: str, month_limit: float, stock_limit: float, months: int, stocks: int) -> DataFrame:
    """Whether a concentration gate fails by one or two events only: few events make shares coarse."""
    n = events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    most = lambda c, a: events.groupBy(*by, c).agg(F.count(F.lit(1)).alias("c")).groupBy(*by).agg(F.max("c").alias(a))
    j = n.join(most(month, "m"), by).join(most(stock, "s"), by)
    over = lambda c, limit: F.greatest(F.lit(0), F.col(c) - F.floor(limit * F.col("n") + 1e-12))
    j = j.withColumns({"month_excess": over("m", month_limit), "stock_excess": over("s", stock_limit)})
    worst = F.greatest("month_excess", "stock_excess")
    return j.select(*by, F.col("n").alias("events"), six(F.col("m") / F.col("n")).alias("month_share"), six(F.col("s") / F.col("n")).alias("stock_share"), six(F.ceil(F.col("n") / months) / F.col("n")).alias("least_month_share"), six(F.ceil(F.col("n") / stocks) / F.col("n")).alias("least_stock_share"), "month_excess", "stock_excess", ((1 / F.col("n") > 0.05) | ((worst > 0) & (worst <= 2))).alias("fragile"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Intersection, union and Jaccard share of two id sets."""
    j = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full_outer")
    both = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    return j.agg(both.alias("intersection"), F.count(F.lit(1)).alias("union"), six(F.try_divide(both, F.count(F.lit(1)))).alias("jaccard"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))
