"""Forward-looking outcomes: never usable as features. All of them read a bounded run of the following bars of the same session, so they are one window and array expressions over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.numbers import log, ratio
from strandline.functions.windows import ordered, six

SESSION, BAR = ["symbol", "session"], ["bar_index"]
PRICES = ["bar_index", "open", "high", "low", "close"]


def with_path(bars: DataFrame, first: int, last: int, columns: Sequence[str] = PRICES) -> DataFrame:
    """Adds ``path``: the bars from ``first`` to ``last`` rows on (0: this one), and ``whole``: whether they are all there without a gap."""
    frame = ordered(SESSION, BAR).rowsBetween(first, last)
    b = bars.withColumn("path", F.collect_list(F.struct(*columns)).over(frame))
    n = last - first + 1
    return b.withColumn("whole", (F.size("path") == n) & (F.get("path", F.lit(n - 1))["bar_index"] == F.col("bar_index") + last) & (F.get("path", F.lit(0))["bar_index"] == F.col("bar_index") + first))


def _first(path: Column, hit) -> Column:
    """The place (from 1) of the first bar of a path for which a condition holds, or null."""
    return F.array_min(F.filter(F.transform(path, lambda x, i: F.when(hit(x), i + 1)), lambda x: x.isNotNull()))


def _where(values: Column, value: Column) -> Column:
    return F.array_position(values, value).cast("int")


def sigma(iv: Column, minutes: int, year: int = 252 * 390) -> Column:
    """The standard deviation that an implied volatility gives for so many minutes."""
    return iv * (minutes / year) ** 0.5


def expected_absolute(iv: Column, minutes: int) -> Column:
    return sigma(iv, minutes) * (2 / 3.141592653589793) ** 0.5


def checkpoint_outcomes(bars: DataFrame, horizon: int, iv: Column, minutes: int = 60, multiples: Sequence[float] = (1.0, 1.5, 2.0)) -> DataFrame:
    """Entry at this bar's open: signed and absolute log return, excursions and their times, path range, and per multiple of the implied deviation when and where it is first passed and whether the return comes back inside. Null where a bar is missing."""
    b = with_path(bars, 0, horizon - 1).withColumn("sigma", sigma(iv, horizon * minutes))
    logs = lambda c: F.transform("path", lambda x: log(ratio(x[c], "open")))
    b = b.withColumns({"up": logs("high"), "down": logs("low"), "ret": log(ratio(F.get("path", F.lit(horizon - 1))["close"], "open"))})
    b = b.withColumns({"max_up": F.array_max("up"), "max_down": F.array_min("down")})
    best = F.greatest(F.col("max_up"), F.abs("max_down"))
    out = {
        "signed_return": F.round("ret", 6), "exceeds": F.abs("ret") > sigma(iv, horizon * minutes) * (2 / 3.141592653589793) ** 0.5, "max_up": F.round("max_up", 6), "max_down": F.round("max_down", 6), "time_up": _where(F.col("up"), F.col("max_up")), "time_down": _where(F.col("down"), F.col("max_down")),
        "path_range": F.round(log(ratio(F.array_max(F.transform("path", lambda x: x["high"])), F.array_min(F.transform("path", lambda x: x["low"])))), 6), "sigma_ratio": F.round(best / (F.col("sigma") + 1e-12), 4), "crossed": F.exists("path", lambda x: x["high"] > F.col("open")) & F.exists("path", lambda x: x["low"] < F.col("open")), "reverted": (best / (F.col("sigma") + 1e-12) >= 1.5) & (F.abs("ret") <= 0.5 * best),
    }
    for m in multiples:
        name, limit = str(m).replace(".", "_"), m * F.col("sigma")
        hit = F.zip_with("up", "down", lambda u, d: F.struct((u > limit).alias("u"), (F.abs(d) > limit).alias("d")))
        at = _first(hit, lambda x: x["u"] | x["d"])
        one = F.get(hit, at - 1)
        out |= {f"time_{name}": at, f"side_{name}": F.when(at.isNull(), "none").when(one["u"] & one["d"], "both").when(one["u"], "up").otherwise("down"), f"back_{name}": at.isNotNull() & (F.abs("ret") <= limit)}
    return b.select(*SESSION, "bar_index", *[F.when(F.col("whole"), c).alias(n) for n, c in out.items()])


def direction_targets(bars: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """For a signal at this bar's close and an entry at the next bar's open: returns before, between and after, excursions both ways, the direction (null for none) and how much of the whole move came after the entry."""
    most = max(horizons)
    b = with_path(bars, 1, most).withColumn("start", F.first("open").over(ordered(SESSION, BAR).rowsBetween(Window.unboundedPreceding, 0)))
    entry = F.get("path", F.lit(0))["open"]
    b = b.withColumns({"entry": entry, "before": log(ratio("close", "start")), "gap": log(ratio(entry, "close"))}).where("whole")
    out = [six(F.col("before")).alias("before"), six(F.col("gap")).alias("gap")]
    for h in horizons:
        run = F.slice("path", 1, h)
        close = F.get("path", F.lit(h - 1))["close"]
        signed = log(ratio(close, "entry"))
        up, down = F.greatest(F.array_max(F.transform(run, lambda x: log(ratio(x["high"], "entry")))), F.lit(0.0)), F.greatest(F.array_max(F.transform(run, lambda x: log(ratio("entry", x["low"])))), F.lit(0.0))
        all_ = F.abs("before") + F.abs("gap") + F.abs(signed)
        out += [six(signed).alias(f"return_{h}"), six(up).alias(f"up_{h}"), six(down).alias(f"down_{h}"), F.when(close != F.col("entry"), (close > F.col("entry")).cast("int")).alias(f"direction_{h}"), six(ratio(F.abs(signed), all_)).alias(f"after_{h}")]
    return b.select(*SESSION, "bar_index", *out)


def event_horizons(bars: DataFrame, direction: Column, horizons: Sequence[int]) -> DataFrame:
    """Payoffs of fixed horizons from the open of the bar right after an event's bar; a horizon whose bars are not exactly there is left out."""
    b = with_path(bars, 1, max(horizons)).withColumn("direction", direction)
    entry = F.get("path", F.lit(0))
    b = b.where(F.coalesce(entry["bar_index"] == F.col("bar_index") + 1, F.lit(False))).withColumn("entry", entry["open"])
    rows = b.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("exit", F.get("path", F.col("horizon") - 1))
    exact = rows.where(F.coalesce(F.col("exit.bar_index") == F.col("bar_index") + F.col("horizon"), F.lit(False)))
    raw = 10000 * (F.col("exit.close") / F.col("entry") - 1)
    return exact.select(*SESSION, "bar_index", "horizon", "entry", F.col("exit.close").alias("exit_price"), F.round(raw, 4).alias("raw_bps"), F.round(F.col("direction") * raw, 4).alias("signed_bps"))


def stop_target(direction: Column, risk_bps: Column, target_r: float, cost_bps: float, ret: str, mfe: str, mae: str) -> dict[str, Column]:
    """A target, stop or time exit from forward columns: where both are touched, the order is not known and the stop counts."""
    good = F.when(direction > 0, F.col(mfe)).otherwise(-F.col(mae)) * 10000
    bad = F.when(direction > 0, -F.col(mae)).otherwise(F.col(mfe)) * 10000
    stop, target = bad >= risk_bps, good >= risk_bps * target_r
    reason = F.when(stop & target, "ambiguous_stop_first").when(stop, "stop").when(target, "target").otherwise("time_exit")
    gross = F.when(stop, -1.0).when(target, target_r).otherwise(direction * F.col(ret) * 10000 / risk_bps)
    return {"exit_reason": reason, "gross_r": F.round(gross, 5), "net_r": F.round(gross - cost_bps / risk_bps, 5)}


def stop_models(events: DataFrame, risks: dict[str, Column], direction: Column, target_r: float, ret: str, mfe: str, mae: str) -> DataFrame:
    """R multiples of several stop models: final, with stops at -1, the best and the worst; events whose risk is not above zero drop out."""
    e = events.withColumn("__m", F.explode(F.array(*[F.struct(F.lit(n).alias("model"), r.cast("double").alias("risk")) for n, r in risks.items()])))
    e = e.withColumns({"model": F.col("__m.model"), "risk": F.when(F.col("__m.risk") > 0, F.col("__m.risk"))}).where("risk is not null")
    good = F.when(direction > 0, F.col(mfe)).otherwise(-F.col(mae)) * 10000
    bad = F.when(direction > 0, -F.col(mae)).otherwise(F.col(mfe)) * 10000
    final, stop = direction * F.col(ret) * 10000 / F.col("risk"), bad >= F.col("risk")
    return e.groupBy("model").agg(F.count(ret).alias("events"), F.count_if(stop).alias("stops"), F.count_if(good >= F.col("risk") * target_r).alias("targets"), F.round(F.avg(final), 4).alias("mean_r"), F.round(F.avg(F.when(stop, -1.0).otherwise(final)), 4).alias("mean_conservative_r"), F.round(F.percentile(good / F.col("risk"), F.lit(0.5)), 4).alias("median_best_r"))


def remaining_payoff(bars: DataFrame, direction: Column, terminal: int, delay: int = 0, cost_bps: float = 5.0) -> DataFrame:
    """Entry at the open two bars after the anchor (and a delay), exit at the original terminal's close, ``terminal`` bars after the anchor; no other bar stands in for a missing one. The status says why there is no payoff."""
    start = 2 + delay
    b = with_path(bars, 1, terminal).withColumn("direction", direction)
    at = lambda k: F.filter("path", lambda x: x["bar_index"] == F.col("bar_index") + k)
    b = b.withColumns({"entry": F.get(at(start), F.lit(0))["open"], "exit": F.get(at(terminal), F.lit(0))["close"], "run": F.filter("path", lambda x: (x["bar_index"] >= F.col("bar_index") + start) & (x["bar_index"] <= F.col("bar_index") + terminal))})
    status = F.when(F.lit(start >= terminal), "too_late").when(F.col("entry").isNull(), "missing_exact_entry_bar").when(F.col("exit").isNull(), "missing_exact_terminal_bar").when(F.size("run") < terminal - start + 1, "incomplete_constant_terminal_path").otherwise("available")
    gross = 10000 * F.col("direction") * (F.col("exit") / F.col("entry") - 1)
    good = F.array_max(F.transform("run", lambda x: F.when(F.col("direction") == 1, 10000 * (x["high"] / F.col("entry") - 1)).otherwise(10000 * (1 - x["low"] / F.col("entry")))))
    b = b.withColumn("status", status)
    ok = F.col("status") == "available"
    return b.select(*SESSION, "bar_index", "status", F.round(F.when(ok, gross), 4).alias("gross"), F.round(F.when(ok, gross - 2 * cost_bps), 4).alias("net"), F.round(F.when(ok, good), 4).alias("mfe"))


def fixed_latency(bars: DataFrame, direction: Column, terminal: int) -> DataFrame:
    """The same terminal entered at the next open and exactly one bar later: both payoffs and their difference."""
    b = with_path(bars, 1, terminal).withColumn("direction", direction).where("whole")
    exit_ = F.get("path", F.lit(terminal - 1))["close"]
    pay = lambda k: 10000 * F.col("direction") * (exit_ / F.get("path", F.lit(k))["open"] - 1)
    return b.select(*SESSION, "bar_index", F.round(pay(0), 4).alias("t0"), F.round(pay(1), 4).alias("t1"), F.round(pay(1) - pay(0), 4).alias("difference"))


def oco_trigger(bars: DataFrame, up: Column, down: Column, horizon: int) -> DataFrame:
    """Which of two resting levels is hit first in the exact following bars: a gap through a level fills at the open, a bar through both is ambiguous, a missing bar ends the search."""
    b = with_path(bars, 1, horizon).withColumns({"up": up, "down": down})
    kind = F.transform("path", lambda x, i: (
        F.when(x["bar_index"] != F.col("bar_index") + i + 1, "missing_exact_market_bar")
        .when(x["open"] >= F.col("up"), "gap_up").when(x["open"] <= F.col("down"), "gap_down")
        .when((x["high"] >= F.col("up")) & (x["low"] <= F.col("down")), "ambiguous_dual_oco_cross")
        .when(x["high"] >= F.col("up"), "cross_up").when(x["low"] <= F.col("down"), "cross_down").otherwise("none")
    ))
    b = b.withColumn("kind", kind).withColumn("step", _first(F.col("kind"), lambda k: k != "none"))
    b = b.withColumn("status", F.coalesce(F.get("kind", F.col("step") - 1), F.when(F.size("path") < horizon, "missing_exact_market_bar").otherwise("no_trigger")))
    x = F.get("path", F.col("step") - 1)
    price = F.when(F.col("status") == "gap_up", F.greatest(x["open"], F.col("up"))).when(F.col("status") == "gap_down", F.least(x["open"], F.col("down"))).when(F.col("status") == "cross_up", F.col("up")).when(F.col("status") == "cross_down", F.col("down"))
    return b.select(*SESSION, "bar_index", "status", F.when(F.col("status").endswith("_up"), 1).when(F.col("status").endswith("_down"), -1).alias("direction"), "step", six(price).alias("price"))


def fill_envelope(trades: DataFrame, keys: list[str], direction: str, entry: str, terminal: str, cost_bps: float, stresses: Sequence[int] = (0, 5, 10, 15, 20)) -> DataFrame:
    """Each trade at several adverse entry slippages, same terminal."""
    t = trades.withColumn("stress", F.explode(F.array(*[F.lit(s) for s in stresses])))
    price = F.col(entry) * (1 + F.col(direction) * F.col("stress") / 10000)
    gross = 10000 * F.col(direction) * (F.col(terminal) / price - 1)
    return t.select(*keys, F.concat(F.lit("F"), F.col("stress").cast("string")).alias("fill_model"), six(price).alias("price"), F.round(gross, 4).alias("gross"), F.round(gross - cost_bps, 4).alias("net"))


def economic_outcome(bars: DataFrame, horizon: int, cost_bps: float, multiple: float = 2.0) -> DataFrame:
    """Next-open entry to the close ``horizon`` bars on, both directions, excursions, the class by a dead band of costs, and which barrier of that size is touched first (a gap counts at the open; both in one bar are their own class)."""
    b = with_path(bars, 1, horizon).where("whole")
    b = b.withColumns({"entry": F.get("path", F.lit(0))["open"], "exit": F.get("path", F.lit(horizon - 1))["close"], "hi": F.array_max(F.transform("path", lambda x: x["high"])), "lo": F.array_min(F.transform("path", lambda x: x["low"]))})
    gross, band = 10000 * (F.col("exit") / F.col("entry") - 1), multiple * cost_bps
    up, down = F.col("entry") * (1 + band / 10000), F.col("entry") * (1 - band / 10000)
    kind = F.transform("path", lambda x: F.when(x["open"] >= up, "UPPER_FIRST").when(x["open"] <= down, "LOWER_FIRST").when((x["high"] >= up) & (x["low"] <= down), "SAME_BAR_DUAL_TOUCH").when(x["high"] >= up, "UPPER_FIRST").when(x["low"] <= down, "LOWER_FIRST").otherwise(""))
    b = b.withColumn("kind", kind).withColumn("step", _first(F.col("kind"), lambda k: k != ""))
    target = F.when(gross > band, "LONG").when(gross < -band, "SHORT").otherwise("NEUTRAL")
    return b.select(*SESSION, "bar_index", F.round(gross, 4).alias("gross_long"), F.round(gross - cost_bps, 4).alias("net_long"), F.round(-gross - cost_bps, 4).alias("net_short"), F.round(10000 * (F.col("hi") / F.col("entry") - 1), 4).alias("mfe_long"), F.round(10000 * (F.col("lo") / F.col("entry") - 1), 4).alias("mae_long"), target.alias("target"), F.coalesce(F.get("kind", F.col("step") - 1), F.lit("NEITHER")).alias("first_touch"), "step")


def relative_outcomes(outcomes: DataFrame, at: list[str], value: str, least: int) -> DataFrame:
    """Future returns against their universe at the same time: residual, average-rank percentile and the class of the outer fifths; unavailable with too few peers."""
    w = Window.partitionBy(*at)
    o = outcomes.where(F.col(value).isNotNull())
    o = o.withColumns({"peers": F.count(F.lit(1)).over(w), "universe": F.avg(value).over(w)})
    o = o.withColumn("residual", F.round(F.col(value) - F.col("universe"), 6))
    rank = F.rank().over(w.orderBy("residual")) + (F.count(F.lit(1)).over(Window.partitionBy(*at, "residual")) - 1) / 2
    o = o.withColumn("percentile", F.try_divide(rank - 1, F.col("peers") - 1))
    target = F.when(F.col("peers") < least, "UNAVAILABLE").when(F.col("percentile") >= 0.8, "LONG").when(F.col("percentile") <= 0.2, "SHORT").otherwise("NEUTRAL")
    return o.select(*SESSION, "bar_index", "peers", F.col("residual"), six(F.col("percentile")).alias("percentile"), target.alias("target"))


def state_path(states: DataFrame, horizon: int) -> DataFrame:
    """What the following states do: transitions, and a short closure: away from this state, back to it, at least two transitions and at most three states on the way. Paths with a gap or past the session are no paths."""
    s = with_path(states, 1, horizon, ["bar_index", "state"]).where("whole").withColumn("next", F.transform("path", lambda x: x["state"]))
    full = F.concat(F.array("state"), F.col("next"))
    s = s.withColumn("all", full).withColumn("transitions", F.size(F.filter(F.zip_with(F.slice("all", 1, horizon), F.col("next"), lambda a, b: a != b), lambda x: x)))
    s = s.withColumn("leave", _first(F.col("next"), lambda x: x != F.col("state")))
    s = s.withColumn("back", F.array_min(F.filter(F.transform("next", lambda x, i: F.when((x == F.col("state")) & (i + 1 > F.col("leave")), i + 1)), lambda x: x.isNotNull())))
    s = s.withColumn("unique", F.when(F.col("back").isNotNull(), F.size(F.array_distinct(F.slice("all", F.col("leave"), F.col("back") - F.col("leave") + 2)))))
    return s.select(*SESSION, "bar_index", "transitions", (F.col("transitions") >= 2).alias("burst"), F.coalesce((F.col("transitions") >= 2) & (F.col("unique") <= 3), F.lit(False)).alias("short_closure"), F.col("back").alias("return_step"))


def first_event_class(events: DataFrame, keys: list[str], step: str, kind: str, known: Sequence[str], horizon: int) -> DataFrame:
    """One class for each decision: the first event inside the horizon; several kinds at once are a tie, a kind that is not known is other, none is no event."""
    inside = events.where(F.col(step).isNull() | ((F.col(step) > 0) & (F.col(step) <= horizon)))
    per = inside.where(F.col(step).isNotNull()).groupBy(*keys, F.col(step).alias("step")).agg(F.array_sort(F.collect_set(kind)).alias("kinds"))
    first = per.groupBy(*keys).agg(F.min_by(F.struct("step", "kinds"), "step").alias("f")).select(*keys, "f.*")
    named = F.get("kinds", F.lit(0))
    cls = F.when(F.col("step").isNull(), "NO_EVENT").when(F.size("kinds") > 1, "DISTINCT_TIE").when(named.isin(*known), named).otherwise("OTHER")
    every = events.select(*keys).distinct().join(first, keys, "left")
    return every.select(*keys, cls.alias("primary_class"), "step")


def competing_risks(rows: DataFrame, keys: list[str], hazards: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    """Constant per-bar hazards to the chance that each kind comes first within each horizon, and that none does."""
    total = sum((F.col(h) for h in hazards), F.lit(0.0))
    r = rows.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("__none", F.pow(1 - total, F.col("horizon")))
    return r.select(*keys, "horizon", six(F.col("__none")).alias("survival"), *[six(F.coalesce(F.try_divide(F.col(h), total), F.lit(0.0)) * (1 - F.col("__none"))).alias(f"incidence_{h}") for h in hazards])


def activation_targets(states: DataFrame, onsets: DataFrame, calendar: DataFrame, family: str, session: str, active: str, windows: Sequence[int]) -> DataFrame:
    """For each forecast and window of following sessions: whether an onset of its family falls into it. What is active now is no candidate, and a window past the calendar has no target."""
    c = calendar.select(session).distinct().withColumn("__n", F.row_number().over(Window.orderBy(session)))
    last = c.agg(F.max("__n").alias("__last"))
    on = onsets.select(family, session).distinct().join(F.broadcast(c), session).groupBy(family).agg(F.array_sort(F.collect_set("__n")).alias("__on"))
    s = states.join(F.broadcast(c), session).join(on, family, "left").withColumn("window", F.explode(F.array(*[F.lit(w) for w in windows]))).withColumn("__one", F.lit(1)).join(F.broadcast(last.withColumn("__one", F.lit(1))), "__one")
    hits = F.filter(F.coalesce("__on", F.array().cast("array<int>")), lambda x: (x > F.col("__n")) & (x <= F.col("__n") + F.col("window")))
    status = F.when(F.col("__n") + F.col("window") > F.col("__last"), "period_boundary").when(F.col(active), "current_active_not_candidate").when(F.size(hits) > 0, "activation_observed").otherwise("no_activation")
    return s.select(family, session, "window", status.alias("status"), F.when(status.isin("activation_observed", "no_activation"), F.get(hits, F.lit(0)) - F.col("__n")).alias("sessions_until"))


def with_hindsight(forecasts: DataFrame, labels: DataFrame, keys: list[str], frozen: str, available: str) -> DataFrame:
    """Labels beside forecasts for evaluation only: refuses a label that was available before the forecast was frozen."""
    j = forecasts.join(labels, keys, "left")
    sound = F.when(F.col(available) < F.col(frozen), F.raise_error(F.lit("label older than the frozen forecast")).cast("boolean")).otherwise(True)
    return j.where(F.coalesce(sound, F.lit(True)))


def active_rows(events: DataFrame, bars: DataFrame, start: str, end: str, kind: str) -> DataFrame:
    """One row for each bar while an event is open, with what happens on the next bar: still open, or how it ends."""
    e = events.withColumn("bar_index", F.explode(F.sequence(F.col(start), F.col(end) - 1)))
    rows = e.join(bars.select(*SESSION, "bar_index"), [*SESSION, "bar_index"])
    return rows.withColumns({"age": F.col("bar_index") - F.col(start), "target": F.when(F.col("bar_index") + 1 == F.col(end), F.col(kind)).otherwise("open")})
