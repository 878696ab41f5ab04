"""Forward-looking labels, events and episodes, state runs and paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.windows import expanding, forward, islands, ordered, six
from strandline.operators.features import BAR, SESSION, opening_range


def forward_returns(bars: DataFrame, horizons: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Label: return to the close h bars on, in the same session."""
    w = ordered(SESSION, BAR)
    return bars.select(*SESSION, "bar_index", *[six(F.lead("close", h).over(w) / F.col("close") - 1).alias(f"fwd_{h}") for h in horizons])


def excursions(bars: DataFrame, horizon: int = 4) -> DataFrame:
    """Label: most favourable and most adverse move within the horizon."""
    w = forward(SESSION, BAR, horizon)
    return bars.select(*SESSION, "bar_index", six(F.max("high").over(w) / F.col("close") - 1).alias("mfe"), six(F.min("low").over(w) / F.col("close") - 1).alias("mae"))


def first_barrier(bars: DataFrame, up: float = 0.2, down: float = 0.2, horizon: int = 6) -> DataFrame:
    """Label: which barrier is touched first; both in one bar count as the stop."""
    w = forward(SESSION, BAR, horizon)
    path = F.collect_list(F.struct("high", "low")).over(w)
    b = bars.select(*SESSION, "bar_index", "close", path.alias("path"))
    first = lambda hit: F.array_min(F.filter(F.transform("path", lambda x, i: F.when(hit(x), i + 1)), lambda x: x.isNotNull()))
    b = b.select(*SESSION, "bar_index", first(lambda x: x["high"] >= F.col("close") * (1 + up)).alias("t"), first(lambda x: x["low"] <= F.col("close") * (1 - down)).alias("s"))
    outcome = F.when(F.col("s").isNotNull() & (F.col("t").isNull() | (F.col("s") <= F.col("t"))), "stop").when(F.col("t").isNotNull(), "target").otherwise("none")
    return b.select(*SESSION, "bar_index", outcome.alias("outcome"), F.coalesce(F.least("t", "s"), F.lit(0)).alias("bars"))


def edge_events(bars: DataFrame, condition: Column) -> DataFrame:
    """Rows where a condition becomes true inside a session."""
    c = F.coalesce(condition, F.lit(False))
    b = bars.withColumn("__c", c).withColumn("__l", F.coalesce(F.lag("__c").over(ordered(SESSION, BAR)), F.lit(False)))
    return b.where("__c and not __l").drop("__c", "__l")


def embargoed(events: DataFrame, embargo: int, by: list[str] = SESSION, order: str = "bar_index") -> DataFrame:
    """Greedy selection in order: an event stays if more than ``embargo`` bars after the last that stayed. A group is one
    session's events, so the aggregate's array is bounded by the session's length."""
    picked = F.aggregate(F.array_sort(F.collect_list(order)), F.array().cast("array<int>"), lambda a, x: F.when((F.size(a) == 0) | (x - F.element_at(a, -1) > embargo), F.concat(a, F.array(x))).otherwise(a))
    return events.groupBy(*by).agg(picked.alias("x")).select(*by, F.explode("x").alias(order))


def merged_intervals(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Unions of overlapping or touching intervals."""
    w = Window.partitionBy(*by).orderBy(start, end)
    far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = rows.withColumn("__new", far.isNull() | (F.col(start) > far))
    numbered = flagged.withColumn("__i", F.sum(F.col("__new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "__i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("__i")


def states(bars: DataFrame) -> DataFrame:
    """State of each bar: the sign of its body, -1, 0 or 1."""
    return bars.select(*SESSION, "bar_index", F.signum(F.col("close") - F.col("open")).cast("int").alias("state"))


def run_ledger(bars: DataFrame) -> DataFrame:
    """Run-length compressed states; a run ends by exit, by a gap or with the session (censored)."""
    w = ordered(SESSION, BAR)
    s = states(bars).withColumns({"gap": F.col("bar_index") - F.lag("bar_index").over(w) != 1, "change": F.col("state") != F.lag("state").over(w)})
    s = s.withColumn("run", islands(F.col("gap") | F.col("change"), SESSION, BAR))
    runs = s.groupBy(*SESSION, "run", "state").agg(F.min("bar_index").alias("start"), F.max("bar_index").alias("end"), F.count(F.lit(1)).alias("duration"))
    following = F.lead("start").over(ordered(SESSION, ["run"]))
    ending = F.when(following.isNull(), "session_end").when(following - F.col("end") > 1, "gap").otherwise("exit")
    return runs.withColumn("ending", ending)


def state_motifs(bars: DataFrame) -> DataFrame:
    """Each run with the states of the two runs before it and how often its three-run motif came before in the session."""
    w = ordered(SESSION, ["run"])
    r = run_ledger(bars).select(*SESSION, "run", "state", F.lag("state", 1).over(w).alias("p1"), F.lag("state", 2).over(w).alias("p2"))
    r = r.where("p2 is not null").withColumn("motif", F.concat_ws(">", "p2", "p1", "state"))
    return r.select(*SESSION, "run", "motif", (F.row_number().over(Window.partitionBy(*SESSION, "motif").orderBy("run")) - 1).alias("seen_before"))


def transition_matrix(bars: DataFrame, pseudo: float = 0.5) -> DataFrame:
    """Run-compressed transition shares with a pseudocount off the diagonal; never across sessions."""
    r = run_ledger(bars)
    pairs = r.select(F.lag("state").over(ordered(SESSION, ["run"])).alias("source"), F.col("state").alias("target"), (F.col("start") - F.lag("end").over(ordered(SESSION, ["run"]))).alias("step"))
    counts = pairs.where("source is not null and source <> target").groupBy("source", "target").count()
    grid = bars.sparkSession.range(1).select(F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("source")).select("source", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("target"))
    full = grid.join(F.broadcast(counts), ["source", "target"], "left").withColumn("x", F.when(F.col("source") == F.col("target"), 0.0).otherwise(F.coalesce("count", F.lit(0)) + pseudo))
    return full.select("source", "target", six(F.col("x") / F.sum("x").over(Window.partitionBy("source"))).alias("p"))


def occupancy(bars: DataFrame) -> DataFrame:
    c = states(bars).groupBy("state").count()
    total = c.agg(F.sum("count").alias("t"))
    return c.join(F.broadcast(total)).select("state", F.col("count").alias("n"), six(F.col("count") / F.col("t")).alias("share"))


def reversal_rate(bars: DataFrame) -> DataFrame:
    """Share of run transitions that return at once to the state before (A B A)."""
    w = ordered(SESSION, ["run"])
    r = run_ledger(bars).select("symbol", "state", F.lag("state", 1).over(w).alias("p1"), F.lag("state", 2).over(w).alias("p2"))
    return r.groupBy("symbol").agg(F.count("p1").alias("transitions"), F.count_if(F.col("p2") == F.col("state")).alias("reversals")).withColumn("rate", six(F.try_divide("reversals", "transitions")))


def duration_hazard(bars: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """Right-censored exit hazard by state and age, smoothed, and survival."""
    r = run_ledger(bars).select("state", "duration", (F.col("ending") == "exit").alias("exited"), F.explode(F.sequence(F.lit(1), F.col("duration").cast("int"))).alias("age"))
    h = r.groupBy("state", "age").agg(F.count(F.lit(1)).alias("at_risk"), F.count_if(F.col("exited") & (F.col("age") == F.col("duration"))).alias("exits"))
    h = h.withColumn("h", (F.col("exits") + alpha) / (F.col("at_risk") + alpha + beta))
    survival = F.exp(F.sum(F.log(1 - F.col("h"))).over(expanding(["state"], ["age"])))
    return h.select("state", "age", "at_risk", "exits", six(F.col("h")).alias("hazard"), six(survival).alias("survival"))


def closures(bars: DataFrame, reach: int = 4) -> DataFrame:
    """Closed walks over runs: from a state, away, and back within ``reach`` runs; the walk as a canonical (smallest) rotation."""
    w = ordered(SESSION, ["run"]).rowsBetween(-reach, 0)
    r = run_ledger(bars).select(*SESSION, "run", "state", F.collect_list("state").over(w).alias("path"))
    before = F.slice("path", F.lit(1), F.size("path") - 1)
    back = F.array_max(F.transform(before, lambda x, i: F.when(x == F.col("state"), i + 1)))
    r = r.select(*SESSION, "run", F.slice("path", back, F.size("path") - back).alias("walk")).where("size(walk) > 1")
    rotations = F.transform(F.sequence(F.lit(1), F.size("walk")), lambda i: F.concat(F.slice("walk", i, F.size("walk")), F.slice("walk", F.lit(1), i - 1)))
    return r.select(*SESSION, "run", F.array_join(F.array_min(rotations), ",").alias("loop"))


def folded(rows: DataFrame, by: list[str], order: str, values: list[str], start: Column, step: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """A rule that goes from row to row: a fold over each group's rows in order, whose array a session's length bounds. ``step(state, row)`` gives the next state; ``out`` names its field that is kept for each row."""
    run = F.array_sort(F.collect_list(F.struct(order, *values)))
    kind = rows.select(start.alias("s")).schema["s"].dataType[out].dataType.simpleString()
    begin = F.struct(start.alias("s"), F.array().cast(f"array<{kind}>").alias("out"))

    def both(acc: Column, row: Column) -> Column:
        state = step(acc["s"], row)
        return F.struct(state.alias("s"), F.concat(acc["out"], F.array(state[out])).alias("out"))

    made = rows.groupBy(*by).agg(run.alias("__rows")).withColumn("__out", F.aggregate("__rows", begin, both, lambda a: a["out"]))
    return made.select(*by, F.explode(F.arrays_zip(F.col("__rows"), F.col("__out"))).alias("z")).select(*by, *[F.col(f"z.__rows.{c}").alias(c) for c in (order, *values)], F.col("z.__out").alias(out))


def hysteresis(posteriors: DataFrame, by: list[str], order: str, switch: float = 0.6, margin: float = 0.1) -> DataFrame:
    """A state is left only for one with a probability of ``switch`` and ``margin`` more; the first is the likeliest (ties: the lowest)."""
    best = lambda p: (F.array_position(p, F.array_max(p)) - 1).cast("int")

    def step(state: Column, row: Column) -> Column:
        top, held, p = best(row["p"]), state["held"], row["p"]
        leave = (F.array_max(p) >= switch) & (F.array_max(p) - F.get(p, held) >= margin)
        return F.struct(F.when(held.isNull() | leave, top).otherwise(held).alias("held"))

    return folded(posteriors, by, order, ["p"], F.struct(F.lit(None).cast("int").alias("held")), step, "held")


def breakout_hold(bars: DataFrame, hours: int = 3, most: int = 5) -> DataFrame:
    """Opening-range template: in at a close above the range, out below its middle or after ``most`` bars (the entry is the first), no second entry."""
    ranges = opening_range(bars, hours).select(*SESSION, "bar_index", "or_high", "or_mid")
    joined = bars.select(*SESSION, "bar_index", "close").join(ranges, [*SESSION, "bar_index"])

    def step(state: Column, row: Column) -> Column:
        inside = state["position"] == 1
        leave = inside & ((row["close"] < row["or_mid"]) | (state["age"] >= most))
        enter = ~inside & ~state["done"] & F.coalesce(row["close"] > row["or_high"], F.lit(False))
        return F.struct(
            F.when(leave, 0).when(enter, 1).otherwise(state["position"]).alias("position"),
            F.when(enter, 1).when(inside & ~leave, state["age"] + 1).otherwise(state["age"]).alias("age"),
            (state["done"] | leave).alias("done"),
        )

    start = F.struct(F.lit(0).alias("position"), F.lit(0).alias("age"), F.lit(False).alias("done"))
    return folded(joined, SESSION, "bar_index", ["close", "or_high", "or_mid"], start, step, "position").select(*SESSION, "bar_index", "position")
