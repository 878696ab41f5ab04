"""Session features, cross-section and daily features over bars; causal by construction (see functions.windows)."""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.windows import before, enough, expanding, islands, ordered, prior, six, trailing

SESSION, BAR = ["symbol", "session"], ["bar_index"]


def with_return(bars: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    last = F.lag("close").over(ordered(by, order))
    return bars.withColumn("ret", F.try_divide(F.col("close"), last) - 1)


def session_clock(bars: DataFrame, length: int = 24) -> DataFrame:
    """Place in the session, bars left, first and last flags, missing bars against the expected grid."""
    whole = Window.partitionBy(*SESSION)
    n, place = F.count(F.lit(1)).over(whole), F.row_number().over(ordered(SESSION, BAR))
    return bars.select(*SESSION, "bar_index", (place - 1).alias("place"), (n - place).alias("remaining"), (place == 1).alias("is_first"), (place == n).alias("is_last"), (length - n).alias("missing"), (F.col("bar_index") * 60).alias("minutes_from_open"))


def session_vwap(bars: DataFrame) -> DataFrame:
    """Running volume-weighted typical price, the distance from it, and on which side the close is."""
    w = expanding(SESSION, BAR)
    v = F.greatest(F.coalesce("volume", F.lit(0.0)), F.lit(0.0))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    total = F.sum(v).over(w)
    vwap = F.when(total > 0, F.sum(typical * v).over(w) / total)
    return bars.select(*SESSION, "bar_index", "close", vwap.alias("v")).select(*SESSION, "bar_index", six(F.col("v")).alias("vwap"), six(F.col("close") / F.col("v") - 1).alias("distance"), (F.col("close") > F.col("v")).alias("above"))


def opening_range(bars: DataFrame, hours: int = 3) -> DataFrame:
    """High, low, middle and width of the first hours; null until they are over and unless all their bars are there."""
    whole, early = Window.partitionBy(*SESSION), F.col("bar_index") < hours
    ready = (F.col("bar_index") >= hours) & (F.count(F.when(early, 1)).over(whole) >= hours)
    high, low = F.max(F.when(early, F.col("high"))).over(whole), F.min(F.when(early, F.col("low"))).over(whole)
    out = bars.select(*SESSION, "bar_index", F.when(ready, high).alias("or_high"), F.when(ready, low).alias("or_low"))
    return out.select("*", six((F.col("or_high") + F.col("or_low")) / 2).alias("or_mid"), six(F.col("or_high") - F.col("or_low")).alias("or_width"))


def relative_volume(bars: DataFrame, sessions: int = 5) -> DataFrame:
    """Volume over its mean at the same place of the sessions before, all of which must be there."""
    w = prior(["symbol", "bar_index"], ["session"], sessions)
    mean = enough(F.avg("volume").over(w), F.count("volume").over(w), sessions)
    return bars.select(*SESSION, "bar_index", six(F.when(mean > 0, F.col("volume") / mean)).alias("relative_volume"))


def previous_session_levels(bars: DataFrame) -> DataFrame:
    """High, low and close of the session before, the opening gap, and whether the open is outside that range."""
    sessions = bars.groupBy(*SESSION).agg(F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "bar_index").alias("c"), F.min_by("open", "bar_index").alias("o"))
    w = ordered(["symbol"], ["session"])
    out = sessions.select(*SESSION, "o", F.lag("h").over(w).alias("prev_high"), F.lag("l").over(w).alias("prev_low"), F.lag("c").over(w).alias("prev_close"))
    return out.select(*SESSION, "prev_high", "prev_low", "prev_close", six(F.col("o") / F.col("prev_close") - 1).alias("gap"), ((F.col("o") > F.col("prev_high")) | (F.col("o") < F.col("prev_low"))).alias("outside"))


def range_compression(bars: DataFrame, recent: int = 3, lookback: int = 6) -> DataFrame:
    """The recent high-low range and its z score over a trailing window (at least two values)."""
    r = F.max("high").over(trailing(SESSION, BAR, recent)) - F.min("low").over(trailing(SESSION, BAR, recent))
    w = trailing(SESSION, BAR, lookback)
    out = bars.select(*SESSION, "bar_index", r.alias("r"))
    z = F.when((F.count("r").over(w) >= 2) & (F.stddev_samp("r").over(w) > 0), (F.col("r") - F.avg("r").over(w)) / F.stddev_samp("r").over(w))
    return out.select(*SESSION, "bar_index", six(F.col("r")).alias("recent_range"), F.round(z, 4).alias("compression_z"))


def bars_since(bars: DataFrame, entry, most: int = 4) -> DataFrame:
    """Bars since the latest entry of the session, and whether the time stop is reached."""
    n = F.row_number().over(ordered(SESSION, BAR))
    out = bars.select(*SESSION, "bar_index", n.alias("n"), entry.alias("entry"))
    held = F.col("n") - F.last(F.when(F.col("entry"), F.col("n")), ignorenulls=True).over(expanding(SESSION, BAR))
    return out.select(*SESSION, "bar_index", held.alias("bars_held"), F.coalesce(held >= most, F.lit(False)).alias("time_stop"))


def segments(bars: DataFrame) -> DataFrame:
    """Maximal gap-free stretches inside a session: first, last, number of bars."""
    gap = F.col("bar_index") - F.lag("bar_index").over(ordered(SESSION, BAR)) != 1
    return bars.withColumn("segment", islands(gap, SESSION, BAR)).groupBy(*SESSION, "segment").agg(F.min("bar_index").alias("start"), F.max("bar_index").alias("end"), F.count(F.lit(1)).alias("bars"))


def cross_section(bars: DataFrame, least: int = 3) -> DataFrame:
    """Return against the others of the same time: average rank in [0, 1], mean, breadth, dispersion, and the rest's median.
    The rest's median is one or two of the middle returns of all, next to the place of the row itself: no row carries its peers."""
    r = with_return(bars, SESSION, BAR).where("ret is not null")
    at = Window.partitionBy("session", "bar_index")
    r = r.withColumns({"place": F.row_number().over(at.orderBy("ret", "symbol")) - 1, "least": F.rank().over(at.orderBy("ret")), "n": F.count(F.lit(1)).over(at)})
    low, high = F.floor((F.col("n") - 2) / 2), F.floor((F.col("n") - 1) / 2)
    at_place = lambda k: F.max(F.when(F.col("place") == k, F.col("ret"))).over(at)
    stats = {"a": at_place(low), "b": at_place(low + 1), "c": at_place(high), "d": at_place(high + 1), "mean": F.avg("ret").over(at), "breadth": F.avg((F.col("ret") > 0).cast("double")).over(at), "sd": F.stddev_samp("ret").over(at), "ties": F.count(F.lit(1)).over(Window.partitionBy("session", "bar_index", "ret"))}
    r = r.withColumns(stats)
    rank = F.col("least") + (F.col("ties") - 1) / 2
    median = F.when(F.col("n") > 1, (F.when(low < F.col("place"), F.col("a")).otherwise(F.col("b")) + F.when(high < F.col("place"), F.col("c")).otherwise(F.col("d"))) / 2)
    return r.select(*SESSION, "bar_index", F.col("n").alias("peers"), six(F.when(F.col("n") >= least, (rank - 1) / (F.col("n") - 1))).alias("rank_score"), six(F.col("ret") - F.col("mean")).alias("relative"), six(F.col("breadth")).alias("breadth"), F.round("sd", 5).alias("dispersion"), six(median).alias("rest_median"))


def regimes(bars: DataFrame, window: int = 10) -> DataFrame:
    """Volatility against its expanding median, trend of two means and drawdown, all from rows before this one."""
    by, order = ["symbol"], ["session"]
    r = with_return(bars, by, order)
    sd = enough(F.stddev_samp("ret").over(prior(by, order, window)), F.count("ret").over(prior(by, order, window)), window)
    n = F.row_number().over(ordered(by, order))
    fast = enough(F.avg("close").over(prior(by, order, window)), n - 1, window)
    slow = enough(F.avg("close").over(prior(by, order, 2 * window)), n - 1, 2 * window)
    down = F.lag("close").over(ordered(by, order)) / F.max("close").over(before(by, order)) - 1
    r = r.select("symbol", "session", "ret", F.round(sd, 9).alias("vol"), F.round(fast - slow, 9).alias("trend"), (down <= -0.10).alias("drawdown"))
    r = scanned(r, by, order, "vol", "median", running_median(window))
    volatility = F.when(F.col("vol").isNull() | F.col("median").isNull(), "unknown").when(F.col("vol") > F.col("median"), "high").otherwise("low")
    return r.select("symbol", "session", "ret", volatility.alias("volatility"), F.when(F.col("trend").isNull(), "unknown").when(F.col("trend") > 0, "up").otherwise("down").alias("trend"), F.coalesce("drawdown", F.lit(False)).alias("drawdown"))


def regime_performance(bars: DataFrame) -> DataFrame:
    r = regimes(bars).where("ret is not null")
    return r.groupBy("volatility").agg(F.count(F.lit(1)).alias("rows"), six(F.avg("ret")).alias("mean_ret"), six(F.avg((F.col("ret") > 0).cast("double"))).alias("win_rate"))


def causal_rank(bars: DataFrame, least: int = 5, window: int = 60) -> DataFrame:
    """Mid-rank of the close among the last ``window`` closes (itself too), scaled to [-1, 1]."""
    w = trailing(["symbol"], ["session"], window)
    seen = bars.select("symbol", "session", "close", F.collect_list("close").over(w).alias("seen"))
    below, same = F.size(F.filter("seen", lambda x: x < F.col("close"))), F.size(F.filter("seen", lambda x: x == F.col("close")))
    return seen.select("symbol", "session", six(F.when(F.size("seen") >= least, ((below + 0.5 * same) / F.size("seen") - 0.5) * 2)).alias("rank_score"))


def ewm(bars: DataFrame, span: int = 20, least: int = 15) -> DataFrame:
    """Exponentially weighted mean of closes, as adjust=False: one pass over each symbol, in blocks with the state carried on."""
    out = scanned(bars.select("symbol", "session", "close"), ["symbol"], ["session"], "close", "mean", running_ewm(2 / (span + 1), least))
    return out.select("symbol", "session", F.round("mean", 2).alias("ewm"))


def running_median(least: int) -> Callable[[np.ndarray], np.ndarray]:
    """The median of all values so far (null: skipped), from a sorted list into which each value is put."""

    def step(values: np.ndarray) -> np.ndarray:
        seen: list[float] = []
        out = np.full(len(values), np.nan)
        for i, v in enumerate(values.tolist()):
            if v == v:
                insort(seen, v)
            n = len(seen)
            if n >= least:
                out[i] = (seen[(n - 1) // 2] + seen[n // 2]) / 2
        return out

    return step


def running_ewm(alpha: float, least: int, block: int = 512) -> Callable[[np.ndarray], np.ndarray]:
    def step(values: np.ndarray) -> np.ndarray:
        out, keep = np.empty(len(values)), (1 - alpha) ** np.arange(block + 1)
        state = values[0] if len(values) else 0.0
        for at in range(0, len(values), block):
            x = values[at : at + block]
            n = len(x)
            out[at : at + n] = keep[1 : n + 1] * state + alpha * keep[:n] * np.cumsum(x / keep[:n])
            state = out[at + n - 1]
        out[: least - 1] = np.nan
        return out

    return step


def scanned(rows: DataFrame, by: list[str], order: list[str], value: str, into: str, step: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Adds what a function makes of each group's values in order: one shuffle, one pass, memory of one group's columns. For running statistics that a frame would compute anew for each row."""
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        values = np.asarray(table.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False), float)
        return table.append_column(into, pa.array(step(values), from_pandas=True))

    return rows.groupBy(*by).applyInArrow(run, schema)


def daily_features(bars: DataFrame) -> DataFrame:
    """Trailing volatility, range ratio, efficiency and sign persistence of daily bars."""
    by, order = ["symbol"], ["session"]
    r = with_return(bars, by, order)
    w = trailing(by, order, 20)
    sign = F.signum("ret")
    r = r.withColumn("same", (sign == F.lag(sign).over(ordered(by, order))).cast("double"))
    vol = enough(F.stddev_samp("ret").over(w) * 252**0.5, F.count("ret").over(w), 20)
    efficiency = F.try_divide(F.abs(F.sum("ret").over(w)), F.sum(F.abs("ret")).over(w))
    return r.select("symbol", "session", F.round(vol, 5).alias("vol20"), six(F.try_divide(F.col("high") - F.col("low"), F.col("close"))).alias("range_ratio"), F.round(enough(efficiency, F.count("ret").over(w), 20), 5).alias("efficiency"), six(enough(F.avg("same").over(w), F.count("same").over(w), 19)).alias("persistence"))
