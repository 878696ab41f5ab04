"""Research runs: splits, grids, template positions, overlays, holding analysis, benchmarks, gated selection, stability, classification and timing nulls. Positions are columns, runs are groups; nothing is looped on the driver but the grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.numbers import log, ratio
from strandline.functions.windows import enough, expanding, islands, ordered, six, trailing
from strandline.operators.backtest import BY, ORDER

SESSION, BAR = ["symbol", "session"], ["bar_index"]
MAX_GRID = 100


def round_trip_bps(spread: float, commission: float, slippage: float) -> float:
    return 2 * (spread + commission + slippage)


# splits and grids


def walk_forward_splits(bars: DataFrame, mode: str = "rolling", train: int = 250, test: int = 60, step: int | None = None, embargo: int = 0, least: int = 0) -> DataFrame:
    """Row ranges by symbol: training slides (rolling), grows (expanding) or stands (fixed, one split); the test starts an embargo after it and never passes the end."""
    if mode not in ("rolling", "expanding", "fixed"):
        raise ValueError(f"mode: {mode}")
    step = step or test
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(least, train + test))
    last = F.floor((F.col("n") - train - embargo - test) / F.lit(step)).cast("int") if mode != "fixed" else F.lit(0)
    s = n.where(F.col("n") >= train + embargo + test).select("symbol", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    offset = F.col("i") * step
    start = offset if mode == "rolling" else F.lit(0)
    end = offset + train
    return s.select("symbol", F.format_string("split_%03d", F.col("i") + 1).alias("split_id"), start.alias("train_start"), end.alias("train_end"), (end + embargo).alias("test_start"), (end + embargo + test).alias("test_end"))


def parameter_grid(spark: SparkSession, space: Mapping[str, Sequence], most: int = MAX_GRID) -> DataFrame:
    """All combinations, keys in order, numbered ps_0001 on; refuses empty choices, windows that are not positive and grids that are too large."""
    if not space or any(not v for v in space.values()):
        raise ValueError("parameter space must not be empty")
    for key, values in space.items():
        if any(w in key for w in ("window", "period", "lookback", "bars")) and any(not isinstance(v, bool | str) and v <= 0 for v in values):
            raise ValueError(f"non-positive value for {key}")
    keys = sorted(space)
    rows = list(product(*(space[k] for k in keys)))
    if len(rows) > most:
        raise ValueError(f"grid of {len(rows)} is larger than {most}")
    return spark.createDataFrame([(f"ps_{i:04d}", *r) for i, r in enumerate(rows, 1)], ["parameter_set_id", *keys])


# template positions


def pullback(bars: DataFrame, trend: int = 20, threshold: float = -0.05, hold: int = 3) -> DataFrame:
    """In an uptrend (the last close over its mean), long for ``hold`` rows after a fall of the last close; all from rows before this one."""
    w = ordered(BY, ORDER)
    last = F.lag("close").over(w)
    b = bars.withColumns({"__last": last, "__fall": F.try_divide(last, F.lag("close", 2).over(w)) - 1})
    mean = enough(F.avg("__last").over(trailing(BY, ORDER, trend)), F.count("__last").over(trailing(BY, ORDER, trend)), trend)
    b = b.withColumn("__in", F.coalesce((F.round(F.col("__last") - mean, 6) > 0) & (F.round("__fall", 9) <= threshold), F.lit(False)))
    return b.withColumn("position", F.max(F.col("__in").cast("double")).over(trailing(BY, ORDER, hold))).drop("__last", "__fall", "__in")


def signals(positions: DataFrame) -> DataFrame:
    """Entries and exits from target positions: the clipped change, the first row's from flat."""
    change = F.col("position") - F.coalesce(F.lag("position").over(ordered(BY, ORDER)), F.lit(0.0))
    return positions.withColumn("signal", F.greatest(F.least(change, F.lit(1.0)), F.lit(-1.0))).withColumns({"entry": F.col("signal") > 0, "exit": F.col("signal") < 0})


def directed(position: Column, direction: str) -> Column:
    """Positions that a direction allows."""
    low, high = {"long_only": (0.0, 1.0), "short_only": (-1.0, 0.0)}.get(direction, (-1.0, 1.0))
    return F.greatest(F.least(position, F.lit(high)), F.lit(low))


# evaluation


def measures(returns: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Net and gross return, costs, trades, exposure, win rate of rebalance rows, and drawdown of evaluated rows (gross, net, turnover, position)."""
    w = expanding(by, order)
    r = returns.withColumn("__e", F.sum(log(1 + F.col("net"))).over(w))
    r = r.withColumn("__d", F.exp(F.col("__e") - F.max("__e").over(w)) - 1)
    traded = F.col("turnover") > 0
    return r.groupBy(*by).agg(
        (F.exp(F.sum(log(1 + F.col("gross")))) - 1).alias("gross_return"), (F.exp(F.sum(log(1 + F.col("net")))) - 1).alias("net_return"), F.sum(F.col("gross") - F.col("net")).alias("costs"), F.count_if(traded).alias("trades"), F.avg(F.abs("position")).alias("exposure"), F.coalesce(F.avg(F.when(traded, (F.col("net") > 0).cast("double"))), F.lit(0.0)).alias("win_rate"), F.min("__d").alias("max_drawdown"),
    )


def scored(rows: DataFrame, by: list[str], order: list[str], bps: float) -> DataFrame:
    """The one-bar lag and costs inside each group: the first row of a group earns nothing and pays its whole position."""
    w = ordered(by, order)
    move = F.coalesce(ratio("close", F.lag("close").over(w)) - 1, F.lit(0.0))
    held = F.coalesce(F.lag("position").over(w), F.lit(0.0))
    turn = F.abs(F.col("position") - held)
    return rows.withColumns({"gross": held * move, "turnover": turn}).withColumn("net", F.col("gross") - F.col("turnover") * bps / 10000)


def baselines(bars: DataFrame, bps: float = 5.0) -> DataFrame:
    """Five simple policies over the same bars in one pass: held, flat, a coin (from a hash of symbol and session), over and under the mean of three closes."""
    mean = F.round(F.avg("close").over(trailing(BY, ORDER, 3)), 6)
    coin = F.substring(F.sha2(F.concat_ws("|", "symbol", "session"), 256), 1, 1).isin(*"01234567").cast("double")
    b = bars.withColumn("__m", mean)
    policies = {"buy_and_hold": F.lit(1.0), "always_flat": F.lit(0.0), "random_entry_exit": coin, "sma_momentum": (F.col("close") > F.col("__m")).cast("double"), "mean_reversion": (F.col("close") < F.col("__m")).cast("double")}
    each = b.withColumn("__p", F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), p.alias("position")) for n, p in policies.items()])))
    rows = each.select("symbol", "session", "close", "__p.policy", "__p.position")
    return measures(scored(rows, ["symbol", "policy"], ORDER, bps), ["symbol", "policy"], ORDER)


def windows(positions: DataFrame, splits: DataFrame, start: str = "test_start", end: str = "test_end") -> DataFrame:
    """The scored rows of each split: every row is dealt to the splits whose range holds it (a row number against a small table)."""
    numbered = positions.withColumn("__n", F.row_number().over(ordered(BY, ORDER)) - 1)
    s = splits.select("symbol", "split_id", F.col(start).alias("__a"), F.col(end).alias("__b"))
    return numbered.join(F.broadcast(s), "symbol").where((F.col("__n") >= F.col("__a")) & (F.col("__n") < F.col("__b"))).drop("__a", "__b", "__n")


def evaluated_windows(positions: DataFrame, splits: DataFrame, bps: float = 5.0, start: str = "test_start", end: str = "test_end") -> DataFrame:
    """Each split scored on its own rows alone; positions come with the context of the rows before it."""
    keys = ["symbol", "split_id"]
    return measures(scored(windows(positions, splits, start, end), keys, ORDER, bps), keys, ORDER)


def against_benchmarks(positions: DataFrame, splits: DataFrame, bps: float = 5.0) -> DataFrame:
    """Mean test net of the positions and of holding over the same windows, and whether the positions are better. Cash earns nothing."""
    mine = evaluated_windows(positions, splits, bps).groupBy("symbol").agg(F.count(F.lit(1)).alias("windows"), six(F.avg("net_return")).alias("selected_net"), six(F.avg("max_drawdown")).alias("selected_drawdown"))
    held = evaluated_windows(positions.withColumn("position", F.lit(1.0)), splits, bps).groupBy("symbol").agg(six(F.avg("net_return")).alias("hold_net"), six(F.avg("max_drawdown")).alias("hold_drawdown"))
    return mine.join(held, "symbol").withColumns({"excess": six(F.col("selected_net") - F.col("hold_net")), "benchmark_pass": F.col("selected_net") > F.col("hold_net")})


def grid_results(bars: DataFrame, splits: DataFrame, grid: Mapping[str, Column], bps: float = 5.0) -> DataFrame:
    """Train and test evidence of each parameter set: all positions are columns of one pass, each row goes once to each split that holds it."""
    wide = bars.select("symbol", "session", "close", *[p.alias(f"__{i}") for i, p in enumerate(grid.values())])
    each = wide.withColumn("__p", F.explode(F.array(*[F.struct(F.lit(n).alias("parameter_set_id"), F.col(f"__{i}").alias("position")) for i, n in enumerate(grid)])))
    rows = each.select("symbol", "session", "close", "__p.parameter_set_id", "__p.position")
    n = rows.withColumn("__n", F.row_number().over(ordered(["symbol", "parameter_set_id"], ORDER)) - 1)
    parts = F.array(F.struct(F.lit("train").alias("side"), F.col("train_start").alias("a"), F.col("train_end").alias("b")), F.struct(F.lit("test").alias("side"), F.col("test_start").alias("a"), F.col("test_end").alias("b")))
    s = splits.select("symbol", "split_id", F.explode(parts).alias("__s")).select("symbol", "split_id", "__s.*")
    keys = ["symbol", "parameter_set_id", "side", "split_id"]
    held = n.join(F.broadcast(s), "symbol").where((F.col("__n") >= F.col("a")) & (F.col("__n") < F.col("b")))
    m = measures(scored(held, keys, ORDER, bps), keys, ORDER)
    side = lambda name, f, c: f(F.when(F.col("side") == name, F.col(c)))
    return m.groupBy("symbol", "parameter_set_id").agg(
        *[x for k in ("train", "test") for x in (six(side(k, F.avg, "net_return")).alias(f"{k}_net_return"), six(side(k, F.avg, "gross_return")).alias(f"{k}_gross_return"), side(k, F.sum, "trades").alias(f"{k}_trade_count"), six(side(k, F.min, "max_drawdown")).alias(f"{k}_max_drawdown"), six(F.avg(F.when(F.col("side") == k, (F.col("net_return") > 0).cast("double")))).alias(f"{k}_profitable_split_pct"), six(side(k, F.sum, "costs")).alias(f"{k}_costs"))]
    )


# selection


def select_parameters(results: DataFrame, least_trades: int = 20, most_drawdown: float = -0.25, least_splits: float = 0.0) -> DataFrame:
    """One parameter set by training evidence alone: gates, then net, split share, trades, drawdown, id. Without any that passes the first id is reported as a fallback. The best test is told but never used."""
    gate = (F.col("train_net_return") > 0) & (F.col("train_trade_count") >= least_trades) & (F.col("train_max_drawdown") >= most_drawdown) & (F.col("train_profitable_split_pct") >= least_splits)
    r = results.withColumn("__ok", F.coalesce(gate, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("__ok"), *[F.when(F.col("__ok"), -F.col(c)) for c in ("train_net_return", "train_profitable_split_pct", "train_trade_count", "train_max_drawdown")], "parameter_set_id"))
    w = Window.partitionBy("symbol")
    r = r.withColumns({"__k": rank, "pass_count": F.sum(F.col("__ok").cast("int")).over(w), "best_test_id": F.min_by("parameter_set_id", F.struct(-F.col("test_net_return"), F.col("parameter_set_id"))).over(w)})
    method = F.when(F.col("__ok"), "train_gated").otherwise("fallback_for_reporting_only")
    return r.where("__k = 1").withColumn("selection_method", method).drop("__k", "__ok")


def stability(results: DataFrame, selected: DataFrame) -> DataFrame:
    """How far the selected set's neighbours share its success, and how much of its training is lost in the test."""
    s = selected.select("symbol", F.col("parameter_set_id").alias("best"), F.col("test_net_return").alias("best_test"), F.col("train_net_return").alias("best_train"))
    j = results.join(F.broadcast(s), "symbol")
    near = F.coalesce(F.avg(F.when(F.col("parameter_set_id") != F.col("best"), (F.col("test_net_return") > 0).cast("double"))), F.lit(0.0))
    g = j.groupBy("symbol", "best").agg(F.first("best_test").alias("best_test"), F.first("best_train").alias("best_train"), six(F.percentile("test_net_return", F.lit(0.5))).alias("median_test"), near.alias("near"))
    clip = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    lost = F.col("best_train") - F.col("best_test")
    score = clip(0.6 * F.col("near") + 0.4 * clip(1 - F.greatest(lost, F.lit(0.0))))
    return g.select("symbol", "best", "median_test", six(F.col("near")).alias("profitable_neighbours"), six(lost).alias("degradation"), six(score).alias("stability_score"), (F.col("near") < 0.5).alias("isolated"))


def classification(least_trades: int = 20, least_splits: float = 0.6, least_stability: float = 0.5, most_drawdown: float = -0.25) -> Column:
    """The first rule of the ladder that applies. Columns: data_errors, leakage_errors, selection_rejected, trade_count, gross, net, cost_drag, benchmark_pass, null_pass, holding (a class or null), profitable_split_pct, stability_score, max_drawdown."""
    c = F.col
    return (
        F.when((c("data_errors") > 0) | (c("leakage_errors") > 0), "rejected_data_issue")
        .when(c("selection_rejected"), "rejected_no_edge")
        .when(c("trade_count") < least_trades, "rejected_too_few_trades")
        .when((c("gross") > 0) & (c("net") <= 0) & (c("cost_drag") > 0), "rejected_costs_kill_edge")
        .when((c("net") <= 0) | ~c("benchmark_pass") | ~c("null_pass"), "rejected_no_edge")
        .when(c("holding").startswith("rejected_"), c("holding"))
        .when(c("profitable_split_pct") < least_splits, "rejected_walkforward_failure")
        .when(c("stability_score") < least_stability, "rejected_unstable_parameters")
        .when(c("max_drawdown") < most_drawdown, "interesting_needs_more_tests")
        .when(c("holding").isin("interesting_intraday_needs_more_tests", "interesting_swing_needs_more_tests", "candidate_intraday_test", "candidate_swing_exceptional"), c("holding"))
        .otherwise("candidate_paper_test")
    )


# timing nulls


def shift_offsets(counts: DataFrame, context: Column, n: str, count: int = 7) -> DataFrame:
    """Seeded circular offsets of each group: multiples of a step that a hash of the context gives, then the smallest that are left."""
    seed = F.conv(F.substring(F.sha2(context, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    span = F.col(n) - 1
    c = counts.where(F.col(n) > 1).withColumn("__step", (F.pmod(seed, span) + 1).cast("long"))
    most = F.least(F.lit(count), span).cast("int")
    own = F.array_distinct(F.transform(F.sequence(F.lit(1), most), lambda k: F.pmod(k * F.col("__step") - 1, span) + 1))
    spare = F.array_except(F.sequence(F.lit(1).cast("long"), F.least(F.lit(2 * count), span).cast("long")), own)
    return c.withColumn("offset", F.explode(F.slice(F.concat(own, spare), F.lit(1), most))).drop("__step")


def timing_null(positions: DataFrame, context: Column, bps: float = 5.0, count: int = 7) -> DataFrame:
    """Net of the positions against that of the same positions moved around the sample: median, nearest-rank quantiles, and whether the real timing is above the third quartile."""
    rows = positions.select("symbol", "session", "close", "position", (F.row_number().over(ordered(BY, ORDER)) - 1).alias("row"))
    counts = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    moves = F.broadcast(shift_offsets(counts, context, "n", count))
    moved = rows.select("symbol", "row", "position").join(moves, "symbol").select("symbol", "offset", F.pmod(F.col("row") + F.col("offset"), F.col("n")).alias("row"), "position")
    both = rows.drop("position").join(moved, ["symbol", "row"])
    keys = ["symbol", "offset"]
    nulls = scored(both, keys, ["row"], bps).groupBy(*keys).agg((F.exp(F.sum(F.log1p("net"))) - 1).alias("net"))
    ranked = nulls.groupBy("symbol").agg(F.array_sort(F.collect_list(F.round("net", 9))).alias("nets"), F.percentile("net", F.lit(0.5)).alias("median"))
    at = lambda q: F.element_at("nets", F.greatest(F.ceil(F.size("nets") * q), F.lit(1)).cast("int"))
    own = scored(rows, ["symbol"], ["row"], bps).groupBy("symbol").agg((F.exp(F.sum(F.log1p("net"))) - 1).alias("net"))
    return own.join(ranked, "symbol").select("symbol", F.size("nets").alias("count"), six(F.col("net")).alias("net"), six(F.col("median")).alias("median_null"), six(at(0.75)).alias("p75_null"), six(at(0.9)).alias("p90_null"), (F.round("net", 9) > at(0.75)).alias("null_pass"))


# holding policy


def session_flat(positions: DataFrame, minutes_to_close: Column, flatten: int, cutoff: int) -> DataFrame:
    """The session-flat overlay. Positions of a session come in stretches that are not flat; a stretch is dropped whole if it was carried in from the session before, or if it starts too late; what is left is flat from ``flatten`` minutes before the close. Adds ``adjusted`` and the reasons."""
    on = F.col("position") != 0
    b = positions.withColumns({"__to": minutes_to_close, "__on": on, "__was": F.coalesce(F.lag(on).over(ordered(SESSION, BAR)), F.lit(False))})
    b = b.withColumn("__run", islands(F.col("__on") & ~F.col("__was"), SESSION, BAR))
    ends = b.groupBy(*SESSION).agg(F.max_by("__on", "bar_index").alias("__last"), F.min_by("__on", "bar_index").alias("__first"), F.min("bar_index").alias("__start"))
    ends = ends.withColumn("__carried", F.coalesce(F.lag("__last").over(ordered(["symbol"], ["session"])), F.lit(False)) & F.col("__first")).select(*SESSION, "__carried")
    b = b.join(ends, SESSION)
    run = Window.partitionBy(*SESSION, "__run")
    begun = F.max("__to").over(run.orderBy("bar_index").rowsBetween(Window.unboundedPreceding, 0))
    b = b.withColumn("__begun", F.when(F.col("__on"), begun))
    blocked = F.col("__carried") & F.col("__on") & (F.col("__run") == 1) & (F.col("bar_index") >= 0)
    carried = blocked & (F.sum((~F.col("__on")).cast("int")).over(expanding(SESSION, BAR)) == 0)
    force, entry = F.col("__to") <= flatten, F.col("__on") & ~F.col("__was")
    b = b.withColumns({"carry_prevented": carried, "late_entry": entry & ~carried & (F.col("__to") <= cutoff), "forced_flat": F.col("__on") & ~carried & force})
    late = F.col("__begun") <= max(cutoff, flatten)
    return b.withColumn("adjusted", F.when(F.col("__on") & ~carried & ~force & ~late, F.col("position")).otherwise(0.0)).drop("__to", "__on", "__was", "__run", "__carried", "__begun")


def policy_effect(overlaid: DataFrame) -> DataFrame:
    """What the overlay did, by symbol."""
    per = overlaid.groupBy(*SESSION).agg(F.bool_or("carry_prevented").alias("c"))
    sessions = per.groupBy("symbol").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("c")).alias("overnight_carry_prevented"))
    g = overlaid.groupBy("symbol").agg(six(F.avg(F.abs("position"))).alias("raw_exposure"), six(F.avg(F.abs("adjusted"))).alias("adjusted_exposure"), F.count_if(F.col("forced_flat")).alias("forced_flat"), F.count_if(F.col("late_entry")).alias("late_entries_blocked"))
    return g.join(sessions, "symbol")


def holding_report(positions: DataFrame, day: Column) -> DataFrame:
    """Longest holding in bars and sessions, nights and weekends held, and how much of the return came over gaps and inside sessions."""
    order = [*ORDER, *BAR]
    w = ordered(BY, order)
    b = positions.withColumns({"__day": day, "__held": F.col("position") != 0})
    b = b.withColumns({"__p": F.lag("position").over(w), "__d": F.lag("__day").over(w), "__c": F.lag("close").over(w), "__run": islands(F.col("__held") != F.lag("__held").over(w), BY, order)})
    runs = b.where("__held").groupBy("symbol", "__run").agg(F.count(F.lit(1)).alias("bars"), F.count_distinct("__day").alias("sessions")).groupBy("symbol").agg(F.max("bars").alias("max_holding_bars"), F.max("sessions").alias("max_holding_sessions"))
    carried, night = F.coalesce(F.col("__p") != 0, F.lit(False)), F.col("__day") != F.col("__d")
    # a Saturday or Sunday after the last day held, up to this one
    weekend = night & (F.datediff("__day", "__d") + F.weekday("__d") >= 5)
    gap, inside = F.col("__p") * (F.col("open") / F.col("__c") - 1), F.col("__p") * (F.col("close") / F.col("__c") - 1)
    part = lambda c, v: six(F.coalesce(F.sum(F.when(carried & c, v)), F.lit(0.0)))
    g = b.groupBy("symbol").agg(F.count_if(carried & night).alias("overnight"), F.count_if(carried & weekend).alias("weekend"), part(night, gap).alias("gap_return"), part(weekend, gap).alias("weekend_return"), part(~night, inside).alias("intraday_return"))
    share = six(F.coalesce(F.try_divide(F.abs("gap_return"), F.abs("gap_return") + F.abs("intraday_return")), F.lit(0.0)))
    return g.withColumn("gap_share", share).join(runs, "symbol", "left")


def holding_decision(most_overnight: int, most_weekend: int, most_gap: float, allow_overnight: bool, allow_weekend: bool, least_trades: int = 0, least_excess: float = 0.0) -> Column:
    """What holding risk does to a result. Columns of holding_report, and session_flat, trade_count, excess."""
    c = F.col
    never = F.lit(False)
    return (
        F.when((c("weekend") > 0) if not allow_weekend else never, "rejected_weekend_risk")
        .when((c("overnight") > 0) if not allow_overnight else never, "rejected_overnight_risk")
        .when(c("session_flat"), "candidate_intraday_test")
        .when(c("weekend") > most_weekend, "rejected_weekend_risk")
        .when((c("overnight") > most_overnight) | (c("gap_share") > most_gap), "rejected_overnight_risk")
        .when((c("trade_count") < least_trades) | (c("excess") < least_excess), "interesting_swing_needs_more_tests")
        .otherwise("candidate_swing_exceptional")
    )


