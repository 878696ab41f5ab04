"""Quotes and trades: top-of-book measures, flows over windows, time-weighted means, impact, replenishment, completed bars, the callback inbox, replay and parity. Windows meet events by buckets of time, so that no key's events are paired with all of its windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.windows import six
from strandline.operators.joins import asof, interval_join

EPSILON = 1e-12


def valid_quote() -> Column:
    """Columns bid, ask, bid_size, ask_size."""
    return F.coalesce((F.col("bid") > 0) & (F.col("ask") >= F.col("bid")) & (F.col("bid_size") >= 0) & (F.col("ask_size") >= 0), F.lit(False))


def quote_primitives(quotes: DataFrame) -> DataFrame:
    """Middle, spread, size imbalance and the microprice's edge of each valid quote; null for the others."""
    mid, spread, size = (F.col("bid") + F.col("ask")) / 2, F.col("ask") - F.col("bid"), F.col("bid_size") + F.col("ask_size")
    edge = (F.col("ask") * F.col("bid_size") + F.col("bid") * F.col("ask_size")) / (size + EPSILON) - mid
    out = {"mid": mid, "spread": spread, "spread_bps": spread / mid * 10000, "imbalance": (F.col("bid_size") - F.col("ask_size")) / (size + EPSILON), "edge": edge, "edge_fraction": F.when(spread / 2 > EPSILON, F.greatest(F.least(edge / (spread / 2), F.lit(1.0)), F.lit(-1.0))).otherwise(0.0)}
    return quotes.withColumns({n: F.when(valid_quote(), c) for n, c in out.items()})


def seconds(time: str | Column) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp") if isinstance(time, str) else time.cast("timestamp")) / 1e6


def standard_windows(points: DataFrame, key: str, at: str, lengths: Sequence[int]) -> DataFrame:
    """Windows of several lengths that end at each point; times are seconds."""
    w = F.explode(F.array(*[F.lit(float(n)) for n in lengths]))
    return points.select(key, F.col(at).alias("w_end"), w.alias("length")).withColumn("w_start", F.col("w_end") - F.col("length"))


def episode_windows(episodes: DataFrame, key: str, trigger: str, entry: str, unit: float = 60.0) -> DataFrame:
    """Eight windows around a trigger and its entry."""
    t, e = F.col(trigger), F.col(entry)
    parts = {"T-15_T-10": (t - 15 * unit, t - 10 * unit), "T-10_T-5": (t - 10 * unit, t - 5 * unit), "T-5_T": (t - 5 * unit, t), "T_entry": (t, e), "entry_5": (e, e + 5 * unit), "entry_10": (e, e + 10 * unit), "entry_15": (e, e + 15 * unit), "entry_30": (e, e + 30 * unit)}
    x = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), a.alias("w_start"), z.alias("w_end")) for n, (a, z) in parts.items()]))
    return episodes.withColumn("__x", x).select(key, trigger, "__x.*")


def inside(events: DataFrame, windows: DataFrame, key: str, at: str, width: float) -> DataFrame:
    """Events with the windows that hold them, both ends included: an equality on key and time bucket, then the exact condition."""
    e = events.withColumn("__b", F.floor(F.col(at) / width))
    w = windows.withColumn("__b", F.explode(F.sequence(F.floor(F.col("w_start") / width), F.floor(F.col("w_end") / width))))
    return e.join(w, [key, "__b"]).where((F.col(at) >= F.col("w_start")) & (F.col(at) <= F.col("w_end"))).drop("__b")


def quote_flow(quotes: DataFrame, windows: DataFrame, key: str, order: list[str], width: float) -> DataFrame:
    """What quotes do in each window: updates, improvements and deteriorations against the quote before (the one that stands when
    the window begins too), states of the market, and the time-weighted imbalance and microprice edge. Columns: t (seconds), bid,
    ask, bid_size, ask_size; each quote stands until the next, clipped to the window."""
    w = Window.partitionBy(key).orderBy("t", *order)
    q = quote_primitives(quotes)
    q = q.withColumns({f"p_{c}": F.lag(c).over(w) for c in ("bid", "ask", "bid_size", "ask_size", "spread")} | {"next": F.lead("t").over(w)})
    moved = (F.col("bid") != F.col("p_bid")) | (F.col("ask") != F.col("p_ask"))
    sized = (F.col("bid_size") != F.col("p_bid_size")) | (F.col("ask_size") != F.col("p_ask_size"))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    flags = {
        "bid_up": F.col("bid") > F.col("p_bid"), "bid_down": F.col("bid") < F.col("p_bid"), "ask_up": F.col("ask") < F.col("p_ask"), "ask_down": F.col("ask") > F.col("p_ask"), "price_updates": moved, "size_updates": ~moved & sized, "tighter": F.col("spread") < F.col("p_spread"), "wider": F.col("spread") > F.col("p_spread"),
        "bid_added": (F.col("bid") == F.col("p_bid")) & (F.col("bid_size") > F.col("p_bid_size")), "bid_removed": (F.col("bid") == F.col("p_bid")) & (F.col("bid_size") < F.col("p_bid_size")), "crossed": F.col("bid") > F.col("ask"), "locked": F.col("bid") == F.col("ask"),
    }
    q = q.withColumns({f"__{n}": one(c) for n, c in flags.items()})
    names = windows.columns
    held = inside(q, windows, key, "t", width)
    span = F.greatest(F.least(F.coalesce("next", "w_end"), F.col("w_end")) - F.col("t"), F.lit(0.0))
    known = F.col("mid").isNotNull()
    sums = {"weighted_imbalance": F.sum(F.when(known, F.col("imbalance") * span)), "weighted_edge": F.sum(F.when(known, F.col("edge") * span)), "known_seconds": F.sum(F.when(known, span))}
    flow = held.groupBy(*names).agg(F.count(F.lit(1)).alias("updates"), *[F.sum(f"__{n}").alias(n) for n in flags], *[c.alias(n) for n, c in sums.items()], F.min("t").alias("first_t"), F.min_by("mid", F.when(known, F.struct("t", *order))).alias("first_mid"), F.max_by("mid", F.when(known, F.struct("t", *order))).alias("last_mid"))
    standing = asof(windows.withColumn("t", F.col("w_start")), q.select(key, "t", "mid", "imbalance", "edge"), [key], ["t"], ["mid", "imbalance", "edge"])
    standing = standing.withColumn("first_in", F.col("asof_t") == F.col("w_start")).drop("t", "asof_t")
    j = standing.join(flow, names, "left")
    before = F.when(F.col("asof_mid").isNotNull() & ~F.coalesce(F.col("first_in"), F.lit(False)), F.least(F.coalesce("first_t", "w_end"), F.col("w_end")) - F.col("w_start")).otherwise(0.0)
    total = F.coalesce("known_seconds", F.lit(0.0)) + before
    mean = lambda c, s: F.when(total > 0, (F.coalesce(s, F.lit(0.0)) + F.coalesce(F.col(c) * before, F.lit(0.0))) / total)
    start = F.when(~F.coalesce(F.col("first_in"), F.lit(False)), F.col("asof_mid"))
    return j.select(*names, F.coalesce("updates", F.lit(0)).alias("updates"), *[F.coalesce(n, F.lit(0)).alias(n) for n in flags], F.round(mean("asof_imbalance", F.col("weighted_imbalance")), 5).alias("mean_imbalance"), F.round(mean("asof_edge", F.col("weighted_edge")), 5).alias("mean_edge"), six(F.col("last_mid") - F.coalesce(start, F.col("first_mid"))).alias("mid_change"), six(F.col("asof_mid")).alias("start_mid"))


def sided_trades(trades: DataFrame, quotes: DataFrame, key: str, order: list[str], most_age: float) -> DataFrame:
    """Trades with their probable side by the quote that stands before them: unclassified without a sound and fresh one, unknown inside or where the market is locked."""
    q = quotes.withColumn("ok", valid_quote()).select(key, "t", *order, "bid", "ask", "ok")
    j = asof(trades, q, [key], ["t", *order], ["bid", "ask", "ok"], strict=True)
    age = F.col("t") - F.col("asof_t")
    side = F.when(~F.coalesce(F.col("asof_ok"), F.lit(False)) | (age < 0) | (age > most_age), "UNCLASSIFIED").when(F.col("asof_ask") <= F.col("asof_bid"), "UNKNOWN").when(F.col("price") >= F.col("asof_ask"), "BUY").when(F.col("price") <= F.col("asof_bid"), "SELL").otherwise("UNKNOWN")
    return j.withColumn("side", side)


def trade_flow(sided: DataFrame, windows: DataFrame, key: str, width: float, least_valid: float) -> DataFrame:
    """Volumes and counts by side in each window, the imbalance (only where enough of the volume has a side), and sizes."""
    held = inside(sided, windows, key, "t", width)
    names = windows.columns
    total = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("size"))), F.lit(0.0))
    g = held.groupBy(*names).agg(total("BUY").alias("buy"), total("SELL").alias("sell"), F.sum("size").alias("all"), F.count_if(F.col("side") == "BUY").alias("buys"), F.count_if(F.col("side") == "SELL").alias("sells"), F.count(F.lit(1)).alias("trades"), F.avg("size").alias("mean_size"), F.percentile("size", F.lit(0.5)).alias("median_size"))
    sided_, fraction = F.col("buy") + F.col("sell"), F.coalesce(F.try_divide(F.col("buy") + F.col("sell"), F.col("all") + EPSILON), F.lit(0.0))
    sound = (fraction >= least_valid) & (sided_ > 0)
    return g.select(*names, "trades", "buys", "sells", six(F.col("buy")).alias("buy"), six(F.col("sell")).alias("sell"), six(F.col("all") - sided_).alias("unknown"), six(fraction).alias("valid_fraction"), six(F.when(sound, (F.col("buy") - F.col("sell")) / (sided_ + EPSILON))).alias("imbalance"), six(F.col("mean_size")).alias("mean_size"), six(F.col("median_size")).alias("median_size"))


def impact(side: str, volume: Column, events: Column, change: Column, start: Column) -> dict[str, Column]:
    """The middle's change the way of a flow, for each unit, each unit of value and in basis points; null without a flow."""
    signed = change if side == "BUY" else -change
    support = (volume > EPSILON) & (events > 0) & signed.isNotNull()
    return {"signed": six(signed), "per_share": F.when(support, F.round(signed / (volume + EPSILON), 7)), "per_notional": F.when(support & (start > 0), F.round(signed / (volume * start + EPSILON), 9)), "bps": F.when(support & (start > 0), F.round(signed / start * 10000, 4))}


def replenishment(sided: DataFrame, quotes: DataFrame, key: str, order: list[str], length: float, width: float) -> DataFrame:
    """What stands again on the side that a probable sell took, within ``length`` seconds: how much was gone at the lowest, how much of it came back, and how long the price held."""
    spans = sided.where("side = 'SELL'").select(key, F.col("t").alias("t0"), (F.col("t") + length + EPSILON).alias("t1"), F.col("asof_bid").alias("start_bid"), "trade_id", "start_size")
    q = quotes.where(valid_quote()).select(key, "t", *order, "bid", "bid_size")
    j = interval_join(q, spans, [key], "t", "t0", "t1", width).where(F.col("t") > F.col("t0"))
    run = F.array_sort(F.collect_list(F.struct("t", *order, F.when(F.col("bid") >= F.col("start_bid"), F.col("bid_size")).otherwise(0.0).alias("s"), (F.col("bid") < F.col("start_bid")).alias("gone"))))
    g = j.groupBy(key, "trade_id", "t0", "start_size").agg(run.alias("r"))
    g = g.withColumn("s", F.transform("r", lambda x: x["s"]))
    low = F.least(F.array_min("s"), F.col("start_size"))
    after = F.slice("s", F.array_position("s", F.array_min("s")).cast("int"), F.size("s"))
    held = F.get(F.transform(F.filter("r", lambda x: x["gone"]), lambda x: x["t"]), F.lit(0)) - F.col("t0")
    return g.select(key, "trade_id", six(F.greatest(F.col("start_size") - low, F.lit(0.0))).alias("depleted"), six(F.greatest(F.array_max(after) - low, F.lit(0.0))).alias("restored"), F.round(F.coalesce(held, F.lit(length)), 3).alias("survived"))


# bars from sub-bars


def tumbling(subs: DataFrame, key: str, at: str, received: str, length: int, step: int) -> DataFrame:
    """Bars from sub-bars: of one sub-bar the update received last counts; a bar is complete only if every expected sub-bar is there with all prices; nothing is filled, and its volume is null if one is. Times are whole seconds."""
    last = subs.withColumn("__k", F.row_number().over(Window.partitionBy(key, at).orderBy(F.desc(received)))).where("__k = 1")
    b = last.withColumn("start", F.floor(F.col(at) / length) * length)
    whole = F.bool_and(F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull())
    on_grid = F.count_distinct(F.when((F.col(at) - F.col("start")) % step == 0, F.col(at)))
    g = b.groupBy(key, "start").agg(F.count(F.lit(1)).alias("subs"), on_grid.alias("__grid"), whole.alias("__whole"), F.min_by("open", at).alias("o"), F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", at).alias("c"), F.when(F.count("volume") == F.count(F.lit(1)), F.sum("volume")).alias("volume"), F.max(at).alias("last_source"), F.max(received).alias("received"))
    complete = (F.col("__grid") == length // step) & (F.col("subs") == length // step) & F.col("__whole")
    price = lambda c: F.when(F.col("__whole"), F.col(c))
    g = g.withColumn("complete", complete)
    as_of = F.when(F.col("complete"), F.col("start") + length).otherwise(F.col("last_source"))
    return g.select(key, "start", "subs", price("o").alias("open"), price("h").alias("high"), price("l").alias("low"), price("c").alias("close"), "volume", "complete", as_of.alias("as_of"), F.greatest(as_of, F.col("received")).alias("checkpoint"))


def finalised(updates: DataFrame, key: str, bar: str, order: list[str]) -> DataFrame:
    """Bars that are updated in place: the last update before a later bar begins is final; the latest bar is not yet."""
    w = Window.partitionBy(key).orderBy(*order)
    u = updates.withColumn("__far", F.max(bar).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    late = F.coalesce(F.col(bar) < F.col("__far"), F.lit(False))
    u = u.withColumn("late", late)
    rank = F.row_number().over(Window.partitionBy(key, bar).orderBy(F.col("late"), *[F.desc(c) for c in order]))
    n_late = F.count_if(F.col("late")).over(Window.partitionBy(key, bar))
    out = u.withColumns({"__k": rank, "late_updates": n_late, "__last": F.max(bar).over(Window.partitionBy(key))}).where("__k = 1 and not late")
    return out.withColumn("final", F.col(bar) < F.col("__last")).drop("__k", "__far", "__last", "late")


def changed_finals(emitted: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Bars that were emitted more than once with other values."""
    same = F.count_distinct(F.struct(*values))
    return emitted.groupBy(*keys).agg(F.count(F.lit(1)).alias("emitted"), same.alias("versions")).where("versions > 1")


def compare_bars(research: DataFrame, live: DataFrame, keys: list[str], by: list[str], tolerance: float) -> DataFrame:
    """How research and live bars differ: on one side only, and where a price is further off than the tolerance."""
    prices = ["open", "high", "low", "close"]
    a = research.select(*keys, *[F.col(p).alias(f"a_{p}") for p in prices]).withColumn("__a", F.lit(1))
    b = live.select(*keys, *[F.col(p).alias(f"b_{p}") for p in prices]).withColumn("__b", F.lit(1))
    off = reduce(Column.__or__, [F.abs(F.col(f"a_{p}") - F.col(f"b_{p}")) > tolerance for p in prices])
    return a.join(b, keys, "full_outer").groupBy(*by).agg(F.count_if(F.col("__b").isNull()).alias("only_research"), F.count_if(F.col("__a").isNull()).alias("only_live"), F.count_if(off).alias("different"), F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("both"))


# inbox, replay, parity


def admit(callbacks: DataFrame, owners: DataFrame, tombstones: DataFrame, request: str, content: Sequence[str], received: str) -> DataFrame:
    """Callbacks by content id, once each (the first received): accepted for an owner, late after a cancellation (kept for diagnosis), or unknown (quarantined). Owners and tombstones are few: one row a request."""
    c = callbacks.withColumn("content_id", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in content]), 256))
    c = c.withColumns({"__k": F.row_number().over(Window.partitionBy("content_id").orderBy(received)), "copies": F.count(F.lit(1)).over(Window.partitionBy("content_id"))}).where("__k = 1").drop("__k")
    j = c.join(owners.select(request, F.lit(True).alias("__owned")), request, "left").join(tombstones.select(request, F.col("cancelled").alias("__gone")), request, "left")
    status = F.when(F.col("__gone").isNotNull() & (F.col(received) >= F.col("__gone")), "expected_late").when(F.col("__owned"), "accepted").otherwise("quarantined")
    return j.withColumn("status", status).drop("__owned", "__gone")


def lease(inbox: DataFrame, acknowledged: DataFrame, key: str, batch: str, order: list[str], limit: int) -> DataFrame:
    """The next callbacks in order that are accepted and not acknowledged, in whole batches: batches are taken while the rows before them are fewer than the limit."""
    open_ = inbox.where("status = 'accepted'").join(acknowledged.select(key).distinct(), key, "left_anti")
    per = open_.groupBy(batch).agg(F.min(F.struct(*order)).alias("__o"), F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__o", batch)
    taken = per.withColumn("__before", F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("__before") < limit)
    return open_.join(F.broadcast(taken.select(batch)), batch, "left_semi")


def compacted(inbox: DataFrame, acknowledged: DataFrame, key: str, received: str, before: Column) -> DataFrame:
    """Acknowledged callbacks older than a time keep their id only."""
    a = acknowledged.select(key).distinct().withColumn("__a", F.lit(True))
    j = inbox.join(a, key, "left").withColumn("compacted", F.coalesce(F.col("__a") & (F.col(received) < before), F.lit(False))).drop("__a")
    return j.select(key, "compacted", *[F.when(~F.col("compacted"), F.col(c)).alias(c) for c in inbox.columns if c != key])


def gaps(events: DataFrame, key: str, at: str, limit: float, as_of: float) -> DataFrame:
    """Silences longer than the limit, and whether a later event has ended them."""
    w = Window.partitionBy(key).orderBy(at)
    e = events.select(key, F.col(at).alias("a"), F.lead(at).over(w).alias("z"))
    until = F.coalesce("z", F.lit(as_of))
    return e.where(until - F.col("a") > limit).select(key, F.round("a", 3).alias("gap_start"), F.round("z", 3).alias("gap_end"), F.when(F.col("z").isNull(), "active").otherwise("resolved").alias("status"))


def trimmed(events: DataFrame, at: str, as_of: Column, keep: float) -> DataFrame:
    """History inside the retention before a time."""
    return events.where((F.col(at) > as_of - keep) & (F.col(at) <= as_of))


def replay_digest(events: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """A digest of each group's events in their total order: the same events give the same digest, whenever and wherever they are replayed. A group is a bounded stretch (a key's day)."""
    line = F.concat_ws("|", *[F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values])
    run = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("events"), F.sha2(F.array_join(F.transform(run, lambda x: x["line"]), "\n"), 256).alias("digest"))


def parity(batch: DataFrame, stream: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows of one side that the other has not, with their multiplicity: equal tables give none."""
    key = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    part = lambda t, n: t.select(*by, key.alias("k")).groupBy(*by, "k").agg(F.count(F.lit(1)).alias(n))
    j = part(batch, "a").join(part(stream, "b"), [*by, "k"], "full_outer")
    more = lambda x, y: F.sum(F.greatest(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)), F.lit(0)))
    return j.groupBy(*by).agg(F.sum(F.least(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)))).alias("same"), more(F.col("a"), F.col("b")).alias("only_batch"), more(F.col("b"), F.col("a")).alias("only_stream"))


