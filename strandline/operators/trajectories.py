"""Further features: clock windows, segments with reasons, transforms, market context, cohorts, vector trajectories, openings and leaders. Causal: windows end at this row or before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.numbers import log, ratio
from strandline.functions.windows import before, enough, expanding, islands, ordered, prior, six, trailing
from strandline.operators.events import folded, run_ledger

SESSION, BAR = ["symbol", "session"], ["bar_index"]


def time_flags(clock: DataFrame, from_open: str, to_close: str, buffer: int = 60, cutoff: int = 180, opening: int = 180, midday: tuple[int, int] = (600, 840), late: int = 1080, flatten: int = 60) -> DataFrame:
    """Which windows of the session a bar is in, and whether a position may be opened."""
    o, c = F.col(from_open), F.col(to_close)
    out = {"after_buffer": o >= buffer, "before_cutoff": c > cutoff, "in_opening": (o >= 0) & (o < opening), "in_midday": (o >= midday[0]) & (o < midday[1]), "in_late": o >= late, "no_entry": c <= cutoff, "must_flatten": c <= flatten}
    return clock.withColumns(out).withColumn("can_open", F.col("after_buffer") & F.col("before_cutoff") & ~F.col("must_flatten"))


def minimum_bars(bars: DataFrame, least: int) -> DataFrame:
    return bars.withColumn("enough_bars", F.row_number().over(ordered(SESSION, BAR)) - 1 >= least)


def feature_report(features: DataFrame, columns: Sequence[str], expected: int) -> DataFrame:
    """Rows, sessions, incomplete sessions and null shares of a feature frame, by symbol: one aggregate on sessions, one on symbols."""
    s = features.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"__{c}") for c in columns])
    return s.groupBy("symbol").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("n") < expected).alias("incomplete"), *[six(F.sum(f"__{c}") / F.sum("n")).alias(f"null_{c}") for c in columns])


def causal_segments(bars: DataFrame, length: int) -> DataFrame:
    """Gap-free stretches with the reason why each begins and ends, the bars missing before it, and its id."""
    w = ordered(SESSION, BAR)
    gap = F.col("bar_index") - F.lag("bar_index").over(w)
    b = bars.withColumn("__gap", gap).withColumn("__s", islands(F.col("__gap") != 1, SESSION, BAR))
    g = b.groupBy(*SESSION, "__s").agg(F.min("bar_index").alias("start"), F.max("bar_index").alias("end"), F.count(F.lit(1)).alias("bars"), F.max(F.when(F.col("__gap") != 1, F.col("__gap") - 1)).alias("missing_before"))
    w = ordered(SESSION, ["__s"])
    last = F.lead("start").over(w).isNull()
    return g.select(*SESSION, F.format_string("%s::%s::segment_%02d", "symbol", "session", F.col("__s") + 1).alias("segment_id"), "start", "end", "bars", F.when(F.col("__s") == 0, F.when(F.col("start") == 0, "session_open").otherwise("late_open")).otherwise("source_gap").alias("start_reason"), F.when(~last, "source_gap").when(F.col("end") == length - 1, "scheduled_session_end").otherwise("early_end").alias("end_reason"), F.coalesce("missing_before", F.lit(0)).alias("missing_before"))


def symbol_features(bars: DataFrame) -> DataFrame:
    """Log return, wicks, sums and deviation of returns and signed efficiency inside gap-free segments, and the volume against the mean of the same bar before (ten sessions at least)."""
    b = bars.withColumn("seg", islands(F.col("bar_index") - F.lag("bar_index").over(ordered(SESSION, BAR)) != 1, SESSION, BAR))
    by = [*SESSION, "seg"]
    w = ordered(by, BAR)
    r = F.ln(F.col("close") / F.lag("close").over(w))
    b = b.withColumn("r", r)
    total = lambda k: enough(F.sum("r").over(trailing(by, BAR, k)), F.count("r").over(trailing(by, BAR, k)), k)
    sd = enough(F.stddev_samp("r").over(trailing(by, BAR, 6)), F.count("r").over(trailing(by, BAR, 6)), 6)
    eff = enough(F.try_divide(F.sum("r").over(trailing(by, BAR, 6)), F.sum(F.abs("r")).over(trailing(by, BAR, 6))), F.count("r").over(trailing(by, BAR, 6)), 6)
    base = before(["symbol", "bar_index"], ["session"])
    volume = enough(F.try_divide(F.col("volume"), F.avg("volume").over(base)), F.count("volume").over(base), 10)
    return b.select(*SESSION, "bar_index", six(F.col("r")).alias("log_return"), six(total(3)).alias("sum_3"), six(total(6)).alias("sum_6"), F.round(sd, 5).alias("sd_6"), F.round(eff, 5).alias("efficiency"), six(volume).alias("relative_volume"))


def emissions(features: DataFrame, columns: dict[str, str]) -> DataFrame:
    """log1p, tanh or ratio transforms of features, by name."""
    make = {"log1p": lambda c: F.log1p(F.greatest(c, F.lit(0.0))), "tanh": F.tanh, "ratio": lambda c: c / (1 + F.abs(c))}
    return features.withColumns({f"emit_{c}": six(make[k](F.col(c))) for c, k in columns.items()})


def market_context(bars: DataFrame, window: int = 20, smooth: int = 15, least: int = 3) -> DataFrame:
    """The market by the medians of its symbols: trend, place under the high and volatility of the sessions before, and their smoothed score."""
    by, order = ["symbol"], ["session"]
    w = trailing(by, order, window)
    n = F.count("close").over(w)
    b = bars.withColumn("r", F.try_divide(F.col("close"), F.lag("close").over(ordered(by, order))) - 1)
    b = b.select("symbol", "session", enough(F.col("close") / F.avg("close").over(w) - 1, n, window).alias("trend"), enough(F.col("close") / F.max("close").over(w) - 1, n, window).alias("high"), enough(F.stddev_samp("r").over(w), F.count("r").over(w), window).alias("vol"))
    half = lambda c: F.percentile(c, F.lit(0.5))
    m = b.groupBy("session").agg(F.count("trend").alias("peers"), half("trend").alias("trend"), half("high").alias("high"), half("vol").alias("vol")).where(F.col("peers") >= least)
    w = Window.orderBy("session")
    m = m.select("session", "peers", *[F.lag(c).over(w).alias(c) for c in ("trend", "high", "vol")])
    score = F.avg(F.col("trend") + F.col("high")).over(w.rowsBetween(1 - smooth, 0))
    return m.select("session", "peers", *[F.round(c, 5).alias(c) for c in ("trend", "high", "vol")], F.round(score, 5).alias("score"))


def confirmed_states(raw: DataFrame, by: list[str], order: str, state: str, confirm: int = 5, hold: int = 15) -> DataFrame:
    """A state changes only after ``confirm`` rows of the new one in a row, and not before it was held ``hold`` rows."""

    def step(s: Column, x: Column) -> Column:
        new = x[state]
        run = F.when(s["held"].isNull() | (new == s["held"]), 0).when(new == s["candidate"], s["run"] + 1).otherwise(1)
        change = s["held"].isNotNull() & (new != s["held"]) & (run >= confirm) & (s["age"] >= hold)
        return F.struct(F.when(s["held"].isNull() | change, new).otherwise(s["held"]).alias("held"), new.alias("candidate"), F.when(change, 0).otherwise(run).alias("run"), F.when(s["held"].isNull() | change, 1).otherwise(s["age"] + 1).alias("age"))

    start = F.struct(F.lit(None).cast(dict(raw.dtypes)[state]).alias("held"), F.lit(None).cast(dict(raw.dtypes)[state]).alias("candidate"), F.lit(0).alias("run"), F.lit(0).alias("age"))
    return folded(raw, by, order, [state], start, step, "held")


def state_efficacy(events: DataFrame, by: list[str], session: str, value: str, windows: Sequence[int]) -> DataFrame:
    """What a state paid in the sessions before: medians by session, then their median and mean over the last w of them."""
    s = events.groupBy(*by, session).agg(F.percentile(value, F.lit(0.5)).alias("m"))
    cols = [x for w in windows for x in (six(F.percentile("m", F.lit(0.5)).over(prior(by, [session], w))).alias(f"median_{w}"), six(F.avg("m").over(prior(by, [session], w))).alias(f"mean_{w}"))]
    return s.select(*by, session, *cols)


def cohort_residuals(rows: DataFrame, at: list[str], value: str) -> DataFrame:
    """Each value against the median of the others at the same time: from the place of the row and the middle values, no row carries its peers."""
    w = Window.partitionBy(*at)
    r = rows.withColumns({"__p": F.row_number().over(w.orderBy(value, "symbol")) - 1, "__n": F.count(value).over(w)})
    low, high = F.floor((F.col("__n") - 2) / 2), F.floor((F.col("__n") - 1) / 2)
    at_place = lambda k: F.max(F.when(F.col("__p") == k, F.col(value))).over(w)
    r = r.withColumns({"__a": at_place(low), "__b": at_place(low + 1), "__c": at_place(high), "__d": at_place(high + 1)})
    median = F.when(F.col("__n") > 1, (F.when(low < F.col("__p"), F.col("__a")).otherwise(F.col("__b")) + F.when(high < F.col("__p"), F.col("__c")).otherwise(F.col("__d"))) / 2)
    return r.withColumn("others", six(median)).withColumn("residual", six(F.col(value) - median)).drop("__p", "__n", "__a", "__b", "__c", "__d")


def cohort_paths(bars: DataFrame, steps: int) -> DataFrame:
    """The cumulative path of the following bars against the cohort's at each step."""
    w = ordered(SESSION, BAR)
    s = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), (10000 * (F.col(f"__{k}") / F.col("close") - 1)).alias("move")) for k in range(1, steps + 1)]))
    b = bars.withColumns({f"__{k}": F.lead("close", k).over(w) for k in range(1, steps + 1)}).select(*SESSION, "bar_index", s.alias("s")).select(*SESSION, "bar_index", "s.*").where("move is not null")
    return cohort_residuals(b, ["session", "bar_index", "step"], "move")


def extended_motifs(bars: DataFrame) -> DataFrame:
    """For each bar its state's age, the two states before, the motifs of the last two to four completed runs, and how often the shortest came before in the session."""
    w = ordered(SESSION, ["run"])
    r = run_ledger(bars)
    p = {f"p{k}": F.lag("state", k).over(w) for k in range(1, 5)}
    r = r.withColumns(p)
    motif = lambda k: F.when(F.col(f"p{k}").isNotNull(), F.concat_ws(">", *[F.col(f"p{i}") for i in range(k, 0, -1)]))
    r = r.withColumns({f"motif_{k}": motif(k) for k in (2, 3, 4)})
    r = r.withColumn("repeats", F.when(F.col("motif_2").isNotNull(), F.row_number().over(Window.partitionBy(*SESSION, "motif_2").orderBy("run")) - 1))
    rows = r.withColumn("bar_index", F.explode(F.sequence("start", "end"))).withColumn("age", F.col("bar_index") - F.col("start") + 1)
    return rows.select(*SESSION, "bar_index", "state", "age", "p1", "p2", "motif_2", "motif_3", "motif_4", "repeats")


def vector_steps(rows: DataFrame, by: list[str], order: str, vector: str) -> DataFrame:
    """How a vector moves: the length of its step, the change of that length, the path over three steps, and how straight it is (the length from end to end over the path)."""
    w = ordered(by, [order])
    length = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    r = rows.withColumns({"__1": F.lag(vector, 1).over(w), "__3": F.lag(vector, 3).over(w)})
    r = r.withColumns({"velocity": length(F.col(vector), F.col("__1")), "__far": length(F.col(vector), F.col("__3"))})
    r = r.withColumns({"acceleration": F.col("velocity") - F.lag("velocity").over(w), "path": F.when(F.col("__3").isNotNull(), F.sum("velocity").over(trailing(by, [order], 3)))})
    return r.select(*by, order, six(F.col("velocity")).alias("velocity"), six(F.col("acceleration")).alias("acceleration"), six(F.col("path")).alias("path"), six(F.try_divide("__far", "path")).alias("consistency"))


def robust_origins(rows: DataFrame, by: list[str], order: str, columns: Sequence[str], window: int, most_path: float | None = None) -> DataFrame:
    """The coordinate-wise median of the rows before; with a limit, only where the path through them was short."""
    w = prior(by, [order], window)
    full = F.count(F.lit(1)).over(w) >= window
    ok = full
    if most_path is not None:
        one = sum((F.abs(F.col(c) - F.lag(c).over(ordered(by, [order]))) for c in columns), F.lit(0.0))
        rows = rows.withColumn("__step", one)
        ok = full & (F.sum("__step").over(prior(by, [order], window - 1)) <= most_path)
    return rows.select(*by, order, *[six(F.when(ok, F.percentile(c, F.lit(0.5)).over(w))).alias(f"origin_{c}") for c in columns], F.coalesce(ok, F.lit(False)).alias("eligible"))


def bar_components(bars: DataFrame) -> DataFrame:
    """Return, true range, place of the close and wicks in basis points; a session's first bar against its own open."""
    last = F.coalesce(F.lag("close").over(ordered(SESSION, BAR)), F.col("open"))
    b = bars.withColumn("__l", last)
    bps = lambda c: F.round(10000 * c / F.col("__l"), 4)
    return b.select(*SESSION, "bar_index", bps(F.col("close") - F.col("__l")).alias("return_bps"), bps(F.greatest("high", "__l") - F.least("low", "__l")).alias("true_range"), six(F.coalesce(F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5))).alias("close_location"), bps(F.col("high") - F.greatest("open", "close")).alias("upper_wick"), bps(F.least("open", "close") - F.col("low")).alias("lower_wick"))


def opening_components(bars: DataFrame, first: int) -> DataFrame:
    """The first bars of a session as one row: return, range, how much of the way was kept, the slope of the closes and the share of rising bars; only if all bars are there."""
    o = bars.where(F.col("bar_index") < first)
    g = o.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("n"), F.min_by("open", "bar_index").alias("o"), F.max_by("close", "bar_index").alias("c"), F.max("high").alias("h"), F.min("low").alias("l"), F.sum(F.abs(F.col("close") - F.col("open"))).alias("way"), F.regr_slope("close", "bar_index").alias("slope"), F.avg((F.col("close") > F.col("open")).cast("double")).alias("rising")).where(F.col("n") == first)
    return g.select(*SESSION, F.round(10000 * (F.col("c") / F.col("o") - 1), 4).alias("return_bps"), F.round(10000 * (F.col("h") - F.col("l")) / F.col("o"), 4).alias("range_bps"), six(F.coalesce(F.try_divide(F.abs(F.col("c") - F.col("o")), F.col("way")), F.lit(0.0))).alias("efficiency"), F.round("slope", 5).alias("slope"), six(F.col("rising")).alias("rising"))


def pressure_slope(bars: DataFrame, window: int) -> DataFrame:
    """The slope of the cumulative signed move over the last bars, by least squares."""
    b = bars.withColumn("p", F.sum(F.signum(F.col("close") - F.col("open")) * F.col("volume")).over(expanding(SESSION, BAR))).withColumn("n", F.row_number().over(ordered(SESSION, BAR)).cast("double"))
    w = trailing(SESSION, BAR, window)
    return b.select(*SESSION, "bar_index", F.col("p").alias("pressure"), six(F.when(F.count("p").over(w) >= window, F.regr_slope("p", "n").over(w))).alias("slope"))


def new_extremes(bars: DataFrame, latest: int) -> DataFrame:
    """How many of the last bars made a new high or low of the session."""
    w = ordered(SESSION, BAR)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    b = bars.withColumns({"__h": F.coalesce(F.col("high") > F.max("high").over(past), F.lit(False)).cast("int"), "__l": F.coalesce(F.col("low") < F.min("low").over(past), F.lit(False)).cast("int")})
    t = trailing(SESSION, BAR, latest)
    return b.select(*SESSION, "bar_index", F.sum("__h").over(t).alias("new_highs"), F.sum("__l").over(t).alias("new_lows"))


def onset(bars: DataFrame, barrier_bps: float, steps: int = 3) -> DataFrame:
    """Which way the following closes first pass a barrier, within exactly so many bars."""
    f = ordered(SESSION, BAR).rowsBetween(1, steps)
    b = bars.withColumn("p", F.transform(F.collect_list("close").over(f), lambda x: 10000 * (x / F.col("close") - 1))).where(F.size("p") == steps)
    b = b.withColumn("side", F.transform("p", lambda x: F.when(x >= barrier_bps, 1).when(x <= -barrier_bps, -1).otherwise(0)))
    first = F.get(F.filter("side", lambda x: x != 0), F.lit(0))
    return b.select(*SESSION, "bar_index", F.coalesce(first, F.lit(0)).alias("onset"))


def market_betas(bars: DataFrame, by: list[str], order: list[str], least: int) -> DataFrame:
    """Slope and level of each symbol's return on the mean return of all at the same time."""
    r = bars.withColumn("r", F.try_divide(F.col("close"), F.lag("close").over(ordered(by, order))) - 1).where("r is not null")
    m = r.withColumn("m", F.avg("r").over(Window.partitionBy(*order)))
    g = m.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("r", "m").alias("beta"), F.regr_intercept("r", "m").alias("alpha")).where(F.col("n") >= least)
    return g.select(*by, "n", F.round("beta", 5).alias("beta"), F.round("alpha", 5).alias("alpha"))


def activity_baseline(bars: DataFrame, least: int = 10) -> DataFrame:
    """Volume over its mean at the same bar of all sessions before, ten at least; null where that is nothing."""
    w = before(["symbol", "bar_index"], ["session"])
    mean = F.avg("volume").over(w)
    return bars.select(*SESSION, "bar_index", six(F.when((F.count("volume").over(w) >= least) & (mean > 1e-12), F.col("volume") / mean)).alias("relative_activity"))


def entry_windows(bars: DataFrame, checkpoints: Sequence[int], lengths: Sequence[int]) -> DataFrame:
    """Return and range over the bars right before a checkpoint; null unless all of them are there."""
    rows = bars.select(*SESSION, "bar_index", "open", "high", "low", "close", F.explode(F.array(*[F.struct(F.lit(c).alias("checkpoint"), F.lit(n).alias("length")) for c in checkpoints for n in lengths])).alias("x")).select("*", "x.*")
    rows = rows.where((F.col("bar_index") < F.col("checkpoint")) & (F.col("bar_index") >= F.col("checkpoint") - F.col("length")))
    whole = F.count(F.lit(1)) == F.first("length")
    return rows.groupBy(*SESSION, "checkpoint", "length").agg(six(F.when(whole, log(ratio(F.max_by("close", "bar_index"), F.min_by("open", "bar_index"))))).alias("ret"), six(F.when(whole, log(ratio(F.max("high"), F.min("low"))))).alias("span"))


def opening_leaders(bars: DataFrame, checkpoints: Sequence[int]) -> DataFrame:
    """Symbols ranked at each checkpoint by their return since the session's first open (ties by name)."""
    first = F.first("open").over(expanding(SESSION, BAR))
    b = bars.withColumn("ret", F.round(F.col("close") / first - 1, 9)).where(F.col("bar_index").isin(*checkpoints))
    k = F.row_number().over(Window.partitionBy("session", "bar_index").orderBy(F.desc("ret"), "symbol"))
    return b.select("symbol", "session", "bar_index", "close", "ret", k.alias("rank"))


def rank_persistence(leaders: DataFrame, signal: int) -> DataFrame:
    """Where the leader of one checkpoint stands at the later ones: rank, among the first two, above the median, and its return since."""
    first = leaders.where((F.col("bar_index") == signal) & (F.col("rank") == 1)).select("session", F.col("symbol").alias("leader"), F.col("close").alias("signal_price"))
    m = leaders.withColumn("median", F.percentile("ret", F.lit(0.5)).over(Window.partitionBy("session", "bar_index")))
    j = m.where(F.col("bar_index") > signal).join(F.broadcast(first), (m["session"] == first["session"]) & (m["symbol"] == first["leader"])).drop(first["session"])
    return j.select("session", "bar_index", "leader", "rank", (F.col("rank") <= 2).alias("top_two"), (F.col("ret") > F.col("median")).alias("above_median"), F.round(10000 * (F.col("close") / F.col("signal_price") - 1), 4).alias("since_bps"))


def completed_history(bars: DataFrame, depth: int = 3) -> DataFrame:
    """At each bar the states of the runs completed before it, the latest first; nothing crosses sessions."""
    w = ordered(SESSION, ["run"])
    r = run_ledger(bars)
    r = r.withColumn("history", F.concat_ws(",", F.array_compact(F.array(*[F.lag("state", k).over(w) for k in range(1, depth + 1)]))))
    return r.withColumn("bar_index", F.explode(F.sequence("start", "end"))).select(*SESSION, "bar_index", "history")


def run_boundaries(bars: DataFrame) -> DataFrame:
    """Runs inside gap-free segments, with the segment and whether a run is the segment's first or last."""
    r = run_ledger(bars)
    w = ordered(SESSION, ["run"])
    fresh = F.col("start") - F.lag("end").over(w) > 1
    r = r.withColumn("segment", islands(fresh, SESSION, ["run"]))
    s = Window.partitionBy(*SESSION, "segment")
    return r.select(*SESSION, "segment", "run", "state", "start", "end", "duration", (F.col("run") == F.min("run").over(s)).alias("is_first"), (F.col("run") == F.max("run").over(s)).alias("is_last"))
