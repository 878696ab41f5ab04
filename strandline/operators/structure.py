"""State events by rule, episodes and their spacing, loops over state runs, prefixes that are alive, routes and classes. Runs are rows; a session bounds every array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.numbers import ratio, rounded
from strandline.functions.windows import expanding, islands, ordered, six, trailing
from strandline.operators.events import folded, run_ledger

SESSION, BAR = ["symbol", "session"], ["bar_index"]

#: The rules of state events over the columns of event_features, as SQL conditions (null: not met). Their limits.
RULES = {
    "controlled_pullback": "(prior_12 > 0.007 OR prior_6 > 0.0045 OR impulse > 0.008) AND (dist_vwap > -0.0015 OR dist_mid > -0.0015 OR dist_mid IS NULL) AND prior_3 <= 0.0025 AND prior_3 > -0.0075 AND depth > -0.018 AND close >= impulse_mid * 0.995 AND (volume_ratio <= 1.1 OR volume_ratio IS NULL) AND close_location >= 0.45 AND (bar_return >= -0.0015 OR close > last_close)",
    "failed_impulse": "(prior_6 > 0.0045 OR prior_12 > 0.008 OR new_high) AND (upper_wick >= 0.32 OR (high > recent_high AND close < recent_high)) AND (close < impulse_mid OR close_location <= 0.45 OR bar_return < 0)",
    "low_reclaim": "(prior_12 < -0.0075 OR prior_6 < -0.0045) AND (new_low OR dist_low < 0.0075 OR low <= recent_low) AND (prior_3 > prior_6 * 0.65 OR close_location >= 0.5) AND (close > recent_low OR lower_wick >= 0.3 OR reclaim > 0.003) AND close_location >= 0.48 AND bar_return >= -0.002",
    "failed_bounce": "prior_12 < -0.006 AND (prior_3 > -0.001 OR high > last_high) AND dist_vwap < 0.001 AND (dist_mid < 0.001 OR dist_mid IS NULL) AND (bar_return <= 0.0005 OR close < last_close) AND close_location <= 0.5 AND (close < or_mid OR or_mid IS NULL)",
    "open_down": "bar_index BETWEEN 3 AND 12 AND dist_vwap < 0 AND (close < or_mid OR close < or_low) AND (prior_6 < -0.0035 OR prior_12 < -0.0045 OR dist_open < -0.003)",
    "slow_snapback": "bar_index BETWEEN 4 AND 20 AND (prior_12 < -0.004 OR dist_low < 0.012) AND reclaim > 0.004 AND prior_3 > -0.001 AND bar_return < 0.004 AND efficiency_6 <= 0.55 AND close_location >= 0.42",
    "dead_chop": "abs(prior_12) <= 0.35 AND efficiency_12 <= 0.38 AND abs(prior_6) <= 0.5",
}
#: The parts whose share is an event's confidence.
PARTS = {
    "controlled_pullback": ["prior_12 > 0.007 OR prior_6 > 0.0045 OR impulse > 0.008", "prior_3 <= 0.0025 AND prior_3 > -0.0075 AND depth > -0.018", "close >= impulse_mid * 0.995"],
    "failed_impulse": ["prior_6 > 0.0045 OR prior_12 > 0.008 OR new_high", "upper_wick >= 0.32", "close_location <= 0.45 OR bar_return < 0"],
    "low_reclaim": ["prior_12 < -0.0075 OR prior_6 < -0.0045", "new_low OR dist_low < 0.0075 OR low <= recent_low", "close_location >= 0.48"],
    "failed_bounce": ["prior_12 < -0.006", "dist_vwap < 0.001", "close_location <= 0.5"],
    "open_down": ["or_mid IS NOT NULL", "dist_vwap < 0", "close < or_mid OR close < or_low", "prior_6 < -0.0035 OR prior_12 < -0.0045"],
    "slow_snapback": ["prior_12 < -0.004 OR dist_low < 0.012", "reclaim > 0.004", "efficiency_6 <= 0.55", "close_location >= 0.42"],
    "dead_chop": ["abs(prior_12) <= 0.35", "efficiency_12 <= 0.38"],
}


def event_features(bars: DataFrame, opening: int = 3) -> DataFrame:
    """What the rules look at: returns over bars before, the place of the close in its bar, distances from the session's means and extremes, the impulse and its volume. All from this bar and earlier ones of its session."""
    w, run = ordered(SESSION, BAR), expanding(SESSION, BAR)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    c = F.col
    back = lambda k: ratio(c("close"), F.lag("close", k).over(w)) - 1
    b = bars.withColumns({
        "bar_return": rounded(ratio(c("close"), c("open")) - 1), "last_close": F.lag("close").over(w), "last_high": F.lag("high").over(w), "recent_high": F.max("high").over(w.rowsBetween(-12, -1)), "recent_low": F.min("low").over(w.rowsBetween(-12, -1)),
        "new_high": F.coalesce(c("high") > F.max("high").over(before), F.lit(False)), "new_low": F.coalesce(c("low") < F.min("low").over(before), F.lit(False)), "first_open": F.first("open").over(run), "low_so_far": F.min("low").over(run),
        "vwap": ratio(F.sum((c("high") + c("low") + c("close")) / 3 * c("volume")).over(run), F.sum("volume").over(run)), "step": F.abs(c("close") - F.lag("close").over(w)),
        "high_12": F.when(F.count("high").over(trailing(SESSION, BAR, 12)) >= 3, F.max("high").over(trailing(SESSION, BAR, 12))), "low_12": F.when(F.count("low").over(trailing(SESSION, BAR, 12)) >= 3, F.min("low").over(trailing(SESSION, BAR, 12))), "ago_12": F.lag("close", 12).over(w),
        "or_high": F.max(F.when(c("bar_index") < opening, c("high"))).over(Window.partitionBy(*SESSION)), "or_low": F.min(F.when(c("bar_index") < opening, c("low"))).over(Window.partitionBy(*SESSION)),
        **{f"prior_{k}": rounded(back(k)) for k in (3, 6, 12)}, "volume_3": F.avg("volume").over(trailing(SESSION, BAR, 3)), "volume_9": F.avg("volume").over(w.rowsBetween(-11, -3)),
    })
    known = c("bar_index") >= opening
    span = c("high") - c("low")
    b = b.withColumns({"or_low": F.when(known, c("or_low")), "or_mid": F.when(known, (c("or_high") + c("or_low")) / 2)})
    travelled = lambda k: F.sum("step").over(trailing(SESSION, BAR, k))
    return b.withColumns({
        "close_location": rounded(F.try_divide(c("close") - c("low"), span)), "upper_wick": rounded(F.try_divide(c("high") - F.greatest("open", "close"), span)), "lower_wick": rounded(F.try_divide(F.least("open", "close") - c("low"), span)), "dist_vwap": rounded(ratio("close", "vwap") - 1), "dist_mid": rounded(ratio(c("close"), c("or_mid")) - 1), "dist_low": rounded(ratio(c("close"), c("low_so_far")) - 1), "dist_open": rounded(ratio(c("close"), c("first_open")) - 1),
        "impulse_mid": F.coalesce(c("ago_12") + (c("high_12") - c("ago_12")) * 0.5, (c("high_12") + c("low_12")) / 2), "impulse": rounded(ratio(c("high_12"), c("ago_12")) - 1), "volume_ratio": rounded(ratio(c("volume_3"), c("volume_9"))), "depth": rounded(ratio(c("close"), c("high_12")) - 1), "reclaim": rounded(ratio(c("close"), c("low_12")) - 1),
        **{f"efficiency_{k}": rounded(F.try_divide(F.abs(c("close") - F.lag("close", k).over(w)), travelled(k))) for k in (6, 12)},
    })


def state_events(features: DataFrame, embargo: int = 4) -> DataFrame:
    """Where a rule begins to hold inside a session, not within ``embargo`` bars of the last event of its kind; with the share of its parts that hold and all rules that hold at that bar."""
    holds = features.withColumns({f"__{n}": F.coalesce(F.expr(r), F.lit(False)) for n, r in RULES.items()})
    confidence = lambda n: six(sum((F.coalesce(F.expr(p), F.lit(False)).cast("double") for p in PARTS[n]), F.lit(0.0)) / len(PARTS[n]))
    w = ordered(SESSION, BAR)
    edges = holds.withColumns({f"__e_{n}": F.col(f"__{n}") & ~F.coalesce(F.lag(f"__{n}").over(w), F.lit(False)) for n in RULES})
    overlap = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"__{n}"), n) for n in RULES])), "|")
    rows = edges.select(*SESSION, "bar_index", overlap.alias("overlap"), F.explode(F.array_compact(F.array(*[F.when(F.col(f"__e_{n}"), F.struct(F.lit(n).alias("state"), confidence(n).alias("confidence"))) for n in RULES]))).alias("x")).select(*SESSION, "bar_index", "overlap", "x.*")
    return spaced(rows, [*SESSION, "state"], "bar_index", embargo, ["confidence", "overlap"])


def spaced(events: DataFrame, by: list[str], order: str, spacing: int, values: list[str] = ()) -> DataFrame:
    """Greedy selection in order: an event stays if it is at least ``spacing`` after the last that stayed."""
    step = lambda s, x: F.struct(F.when(s["last"].isNull() | (x[order] >= s["last"] + spacing), x[order]).otherwise(s["last"]).alias("last"))
    out = folded(events, by, order, list(values), F.struct(F.lit(None).cast(dict(events.dtypes)[order]).alias("last")), step, "last")
    return out.where(F.col("last") == F.col(order)).drop("last").dropDuplicates([*by, order])


def fresh_episodes(rows: DataFrame, value: str, threshold: float, spacing: int, below: bool = True) -> DataFrame:
    """Crossings into a tail, at least ``spacing`` apart."""
    inside = F.col(value) <= threshold if below else F.col(value) >= threshold
    r = rows.withColumn("__in", F.coalesce(inside, F.lit(False)))
    r = r.withColumn("__was", F.lag("__in").over(ordered(SESSION, BAR))).where("__in and __was = false")
    return spaced(r.select(*SESSION, "bar_index", value), SESSION, "bar_index", spacing, [value])


def clustered_runs(rows: DataFrame, inside: Column, gap: int) -> DataFrame:
    """Stretches of rows that are inside, next to each other among all rows and no further apart than ``gap``."""
    w = ordered(SESSION, BAR)
    r = rows.withColumn("__in", F.coalesce(inside, F.lit(False)))
    r = r.withColumn("__new", F.col("__in") & (~F.coalesce(F.lag("__in").over(w), F.lit(False)) | (F.col("bar_index") - F.lag("bar_index").over(w) > gap)))
    r = r.withColumn("__i", islands(F.col("__new"), SESSION, BAR)).where("__in")
    return r.groupBy(*SESSION, "__i").agg(F.min("bar_index").alias("start"), F.max("bar_index").alias("end"), F.count(F.lit(1)).alias("members")).drop("__i")


def surprise_clusters(rows: DataFrame, ratio: str, least: float, length: int, gap: int) -> DataFrame:
    """Triggers whose windows overlap and that follow each other within ``gap``, with the largest ratio and where it is."""
    r = rows.where(F.col(ratio) >= least).select(*SESSION, "bar_index", F.col(ratio).alias("ratio"))
    w = ordered(SESSION, BAR)
    far = F.max(F.col("bar_index") + length).over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("__new", (F.col("bar_index") > far) | (F.col("bar_index") - F.lag("bar_index").over(w) > gap))
    r = r.withColumn("__i", islands(F.col("__new"), SESSION, BAR))
    return r.groupBy(*SESSION, "__i").agg(F.min("bar_index").alias("start"), F.max(F.col("bar_index") + length).alias("end"), F.count(F.lit(1)).alias("members"), six(F.max("ratio")).alias("largest"), F.max_by("bar_index", F.struct("ratio", -F.col("bar_index"))).alias("at")).drop("__i")


def adjacent_intervals(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Unions of intervals that overlap or follow each other without a place between."""
    w = Window.partitionBy(*by).orderBy(start, end)
    far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = rows.withColumn("__new", (F.col(start) > far + 1).cast("int"))
    r = r.withColumn("__i", F.coalesce(F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    return r.groupBy(*by, "__i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("members")).drop("__i")


def flag_episodes(flags: DataFrame, by: list[str], order: str, flag: str) -> DataFrame:
    """Stretches of a calendar on which a flag holds; an episode that reaches the calendar's end is censored."""
    w = ordered(by, [order])
    f = flags.withColumns({"__n": F.row_number().over(w), "__f": F.coalesce(F.col(flag), F.lit(False)), "__total": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    f = f.withColumn("__i", islands(F.col("__f") != F.lag("__f").over(w), by, [order])).where("__f")
    return f.groupBy(*by, "__i").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("sessions"), (F.max("__n") == F.max("__total")).alias("censored")).drop("__i")


def post_anchor_bar(anchors: DataFrame, bars: DataFrame, after: int) -> DataFrame:
    """The bar exactly ``after`` an anchor, never a later one; null where it is missing."""
    b = bars.select(*SESSION, (F.col("bar_index") - after).alias("bar_index"), *[F.col(c).alias(f"post_{c}") for c in ("open", "high", "low", "close")])
    return anchors.join(b, [*SESSION, "bar_index"], "left")


def price_acceptance(rows: DataFrame, reference: str, direction: str) -> DataFrame:
    """Whether the post-anchor bar closes on the right side of the reference and went further that way than the other."""
    move = lambda c: 10000 * (F.col(c) / F.col(reference) - 1)
    long = F.col(direction) == 1
    close, good, bad = F.when(long, move("post_close")).otherwise(-move("post_close")), F.when(long, move("post_high")).otherwise(-move("post_low")), F.when(long, -move("post_low")).otherwise(move("post_high"))
    return rows.withColumns({"signed_close": F.round(close, 4), "balance": F.round(good - bad, 4), "accepted": F.coalesce((close > 0) & (good > bad), F.lit(False))})


# loops over runs


def run_grams(bars: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Every stretch of so many consecutive runs of a session, by the run at which it ends."""
    r = run_ledger(bars)
    most = max(lengths)
    w = ordered(SESSION, ["run"]).rowsBetween(1 - most, 0)
    r = r.select(*SESSION, "run", "state", "start", F.collect_list("state").over(w).alias("back"))
    grams = F.array(*[F.when(F.size("back") >= n, F.slice("back", F.size("back") - n + 1, F.lit(n))) for n in lengths])
    return r.select(*SESSION, "run", "start", F.explode(F.array_compact(grams)).alias("path"))


def path_counts(bars: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """How often each path of states occurs inside sessions."""
    return run_grams(bars, lengths).groupBy(F.array_join("path", ",").alias("path")).agg(F.count(F.lit(1)).alias("n"))


def rotations(core: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(core)), lambda i: F.concat(F.slice(core, i, F.size(core)), F.slice(core, F.lit(1), i - 1)))


def canonical(core: Column) -> Column:
    """The smallest rotation: the same walk from wherever it starts."""
    return F.array_min(rotations(core))


def period(core: Column) -> Column:
    """The length of the shortest walk that a walk repeats."""
    n = F.size(core)
    fits = F.filter(F.sequence(F.lit(1), n), lambda p: (n % p == 0) & (F.slice(core, F.lit(1), n - p) == F.slice(core, p + 1, n)))
    return F.array_min(fits)


def closed_walks(bars: DataFrame, most: int = 6) -> DataFrame:
    """Stretches of runs that end where they began, as canonical walks: primitive (no state twice), a repeat of a primitive, or composite, with its parts cut where the walk comes back to its first state."""
    g = run_grams(bars, range(3, most + 2)).where(F.get("path", F.lit(0)) == F.element_at("path", -1))
    core = F.slice("path", F.lit(1), F.size("path") - 1)
    g = g.withColumn("walk", canonical(core))
    g = g.withColumn("root", F.slice("walk", F.lit(1), period(F.col("walk"))))
    depth = (F.size("walk") / F.size("root")).cast("int")
    simple = F.size(F.array_distinct("root")) == F.size("root")
    kind = F.when(~simple, "composite").when(depth > 1, "repeat").otherwise("primitive")
    g = g.withColumn("again", F.size(F.filter("walk", lambda x: x == F.get("walk", F.lit(0)))))
    g = g.withColumns({"kind": kind, "depth": F.when(simple, depth).otherwise(1)})
    g = g.withColumn("parts", F.when(F.col("kind") == "composite", F.col("again")).otherwise(F.col("depth")))
    return g.select(*SESSION, "run", "start", F.array_join("walk", ",").alias("walk"), F.array_join("root", ",").alias("root"), "depth", "kind", "parts")


def loop_census(walks: DataFrame, least: int, most_share: float) -> DataFrame:
    """Support of each primitive loop: how often, in how many symbols and sessions, what one symbol holds, and why it is not supported."""
    p = walks.where("kind = 'primitive'")
    per = p.groupBy("walk", "symbol").agg(F.count(F.lit(1)).alias("c")).groupBy("walk").agg(F.max("c").alias("most"))
    g = p.groupBy("walk").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("symbols"), F.count_distinct(F.concat_ws("|", *SESSION)).alias("sessions")).join(per, "walk")
    top = F.col("most") / F.col("n")
    reasons = F.array_join(F.array_compact(F.array(F.when(F.col("n") < least, "count"), F.when(F.col("symbols") < 3, "breadth"), F.when(top > most_share, "concentration"))), ",")
    return g.select("walk", "n", "symbols", "sessions", six(top).alias("top_share"), reasons.alias("reasons"))


def select_dictionary(census: DataFrame, most: int, least_coverage: float) -> DataFrame:
    """Supported loops by how much each adds to the covered events: the most frequent first, as an event has one loop, until too little is added."""
    c = census.where("reasons = ''")
    total = census.agg(F.sum("n").alias("__t"), F.lit(1).alias("__one"))
    c = c.withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one").withColumn("marginal", F.col("n") / F.col("__t"))
    w = Window.orderBy(F.desc("n"), "walk")
    c = c.withColumns({"rank": F.row_number().over(w), "coverage": six(F.sum("marginal").over(w.rowsBetween(Window.unboundedPreceding, 0)))})
    return c.where((F.col("rank") <= most) & (F.col("marginal") >= least_coverage)).select("walk", "rank", six(F.col("marginal")).alias("marginal"), "coverage")


def orientations(dictionary: DataFrame) -> DataFrame:
    """Every way to walk each loop: closed paths from each of its states."""
    core = F.transform(F.split("walk", ","), lambda x: x.cast("int"))
    d = dictionary.select("walk", core.alias("core"))
    d = d.select("walk", F.explode(F.array_distinct(rotations(F.col("core")))).alias("o"))
    return d.select("walk", F.concat("o", F.array(F.get("o", F.lit(0)))).alias("path"))


def prefix_registry(dictionary: DataFrame) -> DataFrame:
    """Every proper prefix (two states or more) of every orientation: how far it is and what is left."""
    o = orientations(dictionary)
    p = o.withColumn("progress", F.explode(F.sequence(F.lit(2), F.size("path") - 1)))
    return p.select("walk", F.array_join("path", ",").alias("orientation"), F.array_join(F.slice("path", F.lit(1), F.col("progress")), ",").alias("prefix"), "progress", (F.size("path") - F.col("progress")).alias("remaining"))


def completions(bars: DataFrame, dictionary: DataFrame, most: int = 7) -> DataFrame:
    """Where a run completes a loop of the dictionary: its last states are one of the loop's orientations (an equality of short texts, dictionary sent to all). Several at one run are tied, and a loop that is the end of a longer one is nested in it."""
    g = run_grams(bars, range(3, most + 1)).withColumn("key", F.array_join("path", ","))
    o = F.broadcast(orientations(dictionary).select("walk", F.array_join("path", ",").alias("key")))
    c = g.join(o, "key").select(*SESSION, "run", "start", "walk", F.size("path").alias("states"))
    at = Window.partitionBy(*SESSION, "run")
    return c.select(*SESSION, "run", "start", "walk", "states", (F.count(F.lit(1)).over(at) > 1).alias("tied"), (F.col("states") > F.min("states").over(at)).alias("holds_nested"))


def active_prefixes(bars: DataFrame, dictionary: DataFrame, most: int = 6) -> DataFrame:
    """At each run, the loops that its last states have begun."""
    g = run_grams(bars, range(2, most + 1)).withColumn("prefix", F.array_join("path", ","))
    return g.join(F.broadcast(prefix_registry(dictionary)), "prefix").select(*SESSION, "run", "start", "walk", "orientation", "progress", "remaining")


def first_completions(bars: DataFrame, done: DataFrame, horizon: int) -> DataFrame:
    """For each bar the first later bar within the horizon at which a run that completes a loop begins, and which loops (tied ones in order)."""
    per = done.groupBy(*SESSION, F.col("start").alias("at")).agg(F.array_join(F.array_sort(F.collect_set("walk")), "|").alias("loops"))
    marked = bars.select(*SESSION, "bar_index").join(per, (bars["symbol"] == per["symbol"]) & (bars["session"] == per["session"]) & (F.col("bar_index") == F.col("at")), "left").select(bars["symbol"], bars["session"], "bar_index", "at", "loops")
    following = ordered(SESSION, BAR).rowsBetween(1, Window.unboundedFollowing)
    m = marked.withColumn("next", F.first(F.when(F.col("at").isNotNull(), F.struct("at", "loops")), ignorenulls=True).over(following))
    near = F.col("next.at") - F.col("bar_index") <= horizon
    return m.select(*SESSION, "bar_index", F.when(near, F.col("next.at") - F.col("bar_index")).alias("lead"), F.when(near, F.col("next.loops")).otherwise("none").alias("loops"))


def route_features(prefixes: DataFrame) -> DataFrame:
    """What competes at each run: how many loops are alive and how many kinds, the deepest and the second, how mixed the kinds are, and how that changed since the run before."""
    p = prefixes.withColumn("depth", F.col("progress") / (F.col("progress") + F.col("remaining")))
    per = p.groupBy(*SESSION, "run", "walk").agg(F.count(F.lit(1)).alias("c"), F.max("depth").alias("d"), F.sort_array(F.collect_list("depth"), asc=False).alias("ds"))
    g = per.groupBy(*SESSION, "run").agg(F.sum("c").alias("alive"), F.count(F.lit(1)).alias("kinds"), F.sort_array(F.flatten(F.collect_list("ds")), asc=False).alias("depths"), F.sum(F.col("c") * F.ln("c")).alias("e"))
    top, second = F.get("depths", F.lit(0)), F.coalesce(F.get("depths", F.lit(1)), F.lit(0.0))
    entropy = F.when(F.col("kinds") > 1, F.ln("alive") - F.col("e") / F.col("alive")).otherwise(0.0)
    g = g.select(*SESSION, "run", "alive", "kinds", six(top).alias("top"), six(top - second).alias("margin"), six(entropy).alias("entropy"))
    w = ordered(SESSION, ["run"])
    return g.withColumns({"alive_change": F.col("alive") - F.lag("alive").over(w), "margin_change": six(F.col("margin") - F.lag("margin").over(w))})


def route_state(entropy_high: float, margin_low: float, margin_high: float, top_high: float) -> Column:
    """The class of a route by frozen limits; the last rule that applies wins."""
    broad = (F.col("entropy") >= entropy_high) & (F.col("margin") <= margin_low)
    narrowing = F.coalesce((F.col("alive_change") < 0) & (F.col("margin_change") > 0), F.lit(False))
    dominant = (F.col("top") >= top_high) & (F.col("margin") >= margin_high)
    return F.when(broad, "BROAD_CONFLICT").when(narrowing, "NARROWING").when(dominant, "DOMINANT_ROUTE").when(F.col("alive") <= 2, "LOW_ROUTE_SUPPORT").otherwise("OTHER")


def resolve_ties(done: DataFrame) -> DataFrame:
    """One owner for each run that completes several loops: the shortest, then by name; the others are named with it."""
    w = Window.partitionBy(*SESSION, "run").orderBy("states", "walk")
    d = done.withColumns({"k": F.row_number().over(w), "all": F.array_join(F.array_sort(F.collect_set("walk").over(Window.partitionBy(*SESSION, "run"))), "|")})
    return d.where("k = 1").select(*SESSION, "run", F.col("walk").alias("owner"), "all")


def unregistered(walks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Closed walks whose root is not in the dictionary, by canonical id."""
    return walks.join(F.broadcast(dictionary.select(F.col("walk").alias("root"))), "root", "left_anti").groupBy("root", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("symbols"))


# closures of pairs


def pair_closures(bars: DataFrame) -> DataFrame:
    """One decision at each run's start: the states and lengths of the four runs before, the last closure A-B-A and how long ago, and whether the next run goes back to the state before (censored at a session's end or a gap)."""
    w = ordered(SESSION, ["run"])
    r = run_ledger(bars).select(*SESSION, "run", "state", "start", "duration", "ending")
    r = r.withColumns({f"p{k}": F.lag("state", k).over(w) for k in (1, 2, 3, 4)} | {f"d{k}": F.lag("duration", k).over(w) for k in (1, 2)} | {"next": F.lead("state").over(w)})
    r = r.withColumn("gone", F.when(F.col("p2") == F.col("state"), F.struct("run", "p1", "state")))
    r = r.withColumn("last", F.last("gone", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    free = F.col("ending") == "exit"
    pair = F.concat_ws("|", F.least("last.p1", "last.state"), F.greatest("last.p1", "last.state"))
    return r.where("p1 is not null").select(*SESSION, "run", "start", "state", "p1", "p2", "p3", "p4", "d1", "d2", F.when(F.col("last").isNull(), "none").otherwise(pair).alias("last_pair"), F.coalesce(F.col("run") - F.col("last.run"), F.lit(-1)).alias("recency"), F.when(free, (F.col("next") == F.col("p1")).cast("int")).alias("target"), F.when(free, "available").otherwise(F.concat(F.lit("censored_"), F.col("ending"))).alias("censoring"))


def closure_lift(population: DataFrame) -> DataFrame:
    """Closure rate of each pair (before, now) against that of the other predecessors of the same state: totals less parts."""
    g = population.where("target is not null").groupBy("p1", "state").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("hits"), F.count_distinct("symbol").alias("symbols"))
    w = Window.partitionBy("state")
    other = F.try_divide(F.sum("hits").over(w) - F.col("hits"), F.sum("n").over(w) - F.col("n"))
    rate = F.col("hits") / F.col("n")
    return g.select("p1", "state", "n", "symbols", six(rate).alias("rate"), six(other).alias("other_rate"), six(rate - other).alias("lift"))


# decisions and classes


def irreversible(timeline: DataFrame, by: list[str], order: list[str], decision: str) -> DataFrame:
    """A rejection stays: what is proposed after it is rejected too."""
    before = F.max((F.col(decision) == "reject").cast("int")).over(ordered(by, order).rowsBetween(Window.unboundedPreceding, -1))
    gone = F.coalesce(before == 1, F.lit(False))
    return timeline.withColumns({"decision": F.when(gone, "reject").otherwise(F.col(decision)), "reason": F.when(gone, "prior_rejection_irreversible").otherwise(F.concat(F.lit("proposed_"), F.col(decision)))})


def update_posterior(rows: DataFrame, keys: list[str], competitor: str, prior: str, possible: Column, likelihood: Column, unknown: Column, least: float = 0.05) -> DataFrame:
    """Masses after evidence: impossible competitors lose theirs, the others are weighted (never below ``least``), what is unknown keeps its part, and all are normalised."""
    weight = F.when(possible, F.col(prior) * F.greatest(likelihood, F.lit(least))).otherwise(0.0)
    r = rows.withColumn("__w", weight)
    total = F.sum("__w").over(Window.partitionBy(*keys)) + unknown
    return r.select(*keys, competitor, F.round(F.coalesce(F.try_divide(F.col("__w"), total), F.lit(0.0)), 5).alias("posterior"), F.round(F.coalesce(F.try_divide(unknown, total), F.lit(1.0)), 5).alias("unknown"), F.when(~possible, "impossible").otherwise("possible").alias("status"))


def quiet_class(probability: Column, limits: tuple[float, float, float], high: float) -> dict[str, Column]:
    """Which frozen tails a probability is in, and its distance from the middle one."""
    a, b, c = limits
    return {"bottom_5": probability <= a, "bottom_10": probability <= b, "bottom_20": probability <= c, "high_tail": probability >= high, "distance": six(probability - b)}


def opening_transition(ret: Column, span: Column, low: float, high: float, wide: float) -> Column:
    """The class of an opening: severe both ways only with a wide range; unknown where something is missing."""
    return F.when(ret.isNull() | span.isNull(), "UNKNOWN_INCOMPLETE").when((ret <= low) & (span >= wide), "NEGATIVE_SEVERE_OPENING_TRANSITION").when((ret >= high) & (span >= wide), "POSITIVE_SEVERE_OPENING_TRANSITION").when(span >= wide, "ELEVATED_OPENING_RANGE_NONDIRECTIONAL").otherwise("NORMAL_OPENING")


def shock_state(short: Column, long: Column, limit: float) -> Column:
    """The class of a signed shock by two windows before a checkpoint: both past the limit the same way persist, one alone is fresh or fading."""
    past = lambda x: F.when(x >= limit, 1).when(x <= -limit, -1).otherwise(0)
    a, b = past(short), past(long)
    return F.when(short.isNull() | long.isNull(), "UNKNOWN_INCOMPLETE").when((a != 0) & (a == b), F.when(a > 0, "POSITIVE_PERSISTENT").otherwise("NEGATIVE_PERSISTENT")).when((a != 0) & (b == 0), F.when(a > 0, "POSITIVE_FRESH").otherwise("NEGATIVE_FRESH")).when((a == 0) & (b != 0), F.when(b > 0, "POSITIVE_FADING").otherwise("NEGATIVE_FADING")).when(a != 0, "REVERSING").otherwise("NORMAL")


def completed_decisions(bars: DataFrame, states: DataFrame) -> DataFrame:
    """Exactly one decision for each completed bar, numbered in its session; a state that comes twice for a bar is an error."""
    s = states.groupBy(*SESSION, "bar_index").agg(F.count(F.lit(1)).alias("__n"), F.first("state").alias("state"))
    checked = F.when(F.col("__n") > 1, F.raise_error(F.lit("several states for one bar")).cast("int")).otherwise(F.col("state"))
    j = bars.select(*SESSION, "bar_index").dropDuplicates().join(s, [*SESSION, "bar_index"])
    return j.select(*SESSION, "bar_index", checked.alias("state"), F.row_number().over(ordered(SESSION, BAR)).alias("decision"))


def early_leaders(rows: DataFrame, at: list[str], symbol: str, order: str, value: str, checkpoints: Sequence[int]) -> DataFrame:
    """Who leads a session's running total after so many bars, from prefixes only."""
    c = F.explode(F.array(*[F.lit(k) for k in checkpoints]))
    r = rows.withColumn("checkpoint", c).where(F.col(order) <= F.col("checkpoint")).groupBy(*at, "checkpoint", symbol).agg(six(F.sum(value)).alias("total"))
    k = F.row_number().over(Window.partitionBy(*at, "checkpoint").orderBy(F.desc("total"), symbol))
    return r.withColumn("k", k).where("k = 1").select(*at, "checkpoint", F.col(symbol).alias("leader"), "total")


