"""Checks of rows and bars, dataset statistics and universe gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.windows import islands, ordered, six
from strandline.operators.features import BAR, SESSION, with_return


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def ohlc(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.count_if(F.col("high") < F.greatest("open", "close")).alias("high_below"), F.count_if(F.col("low") > F.least("open", "close")).alias("low_above"), F.count_if(F.col("low") <= 0).alias("non_positive")
    )


def missing_bars(bars: DataFrame, length: int = 24) -> DataFrame:
    """The expected grid of each observed session without what is there."""
    grid = bars.select(*SESSION).distinct().select(*SESSION, F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("bar_index"))
    return grid.join(bars.select(*SESSION, "bar_index"), [*SESSION, "bar_index"], "left_anti")


def quiet_runs(bars: DataFrame, quiet: Column, least: int = 3) -> DataFrame:
    """Stretches of consecutive rows for which a condition holds."""
    b = bars.withColumn("__q", F.coalesce(quiet, F.lit(False)))
    b = b.withColumn("__i", islands(F.col("__q") != F.lag("__q").over(ordered(SESSION, BAR)), SESSION, BAR))
    return b.where("__q").groupBy(*SESSION, "__i").agg(F.min("bar_index").alias("start"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= least).drop("__i")


def large_jumps(bars: DataFrame, limit: float = 0.2) -> DataFrame:
    return with_return(bars, ["symbol"], ["session"]).select("symbol", "session", six(F.col("ret")).alias("jump")).where(F.abs("jump") > limit)


def dataset_stats(bars: DataFrame, recent: int = 60) -> DataFrame:
    """Rows, span, last close, and the median dollar volume of the last rows."""
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("session")))
    r = bars.select("symbol", "session", "close", (F.col("close") * F.col("volume")).alias("dv"), k.alias("k"))
    return r.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.max_by("close", "session").alias("last_close"), six(F.percentile(F.when(F.col("k") <= recent, F.col("dv")), F.lit(0.5))).alias("median_dollar_volume"), F.min("session").alias("first"), F.max("session").alias("last"))


def qualify(stats: DataFrame, history: int, price: float, liquidity: float) -> DataFrame:
    """The reasons against each symbol; none: it qualifies."""
    reasons = F.array_compact(F.array(F.when(F.col("rows") < history, "history"), F.when(F.col("last_close") < price, "price"), F.when(F.col("median_dollar_volume") < liquidity, "liquidity")))
    return stats.select("symbol", F.array_join(reasons, ",").alias("reasons"))


def return_summary(bars: DataFrame) -> DataFrame:
    r = with_return(bars, ["symbol"], ["session"])
    return r.groupBy("symbol").agg(F.count("ret").alias("n"), six(F.avg("ret")).alias("mean"), six(F.min("ret")).alias("low"), six(F.max("ret")).alias("high"), F.round(F.stddev_samp("ret"), 5).alias("sd"))


def largest_moves(bars: DataFrame, k: int = 5) -> DataFrame:
    r = with_return(bars, ["symbol"], ["session"]).where("ret is not null").withColumn("x", F.abs("ret"))
    n = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("x"), "session"))
    return r.withColumn("k", n).where(F.col("k") <= k).select("symbol", "session", six(F.col("x")).alias("move"))
