"""Two-stage and robust aggregates, classification metrics, multiple-testing adjustments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.windows import six


def two_stage(fills: DataFrame, cell: Sequence[str], unit: str, value: str, cap: float) -> DataFrame:
    """Fills to one capped mean for each unit, then the median, MAD and positive share of units in a cell."""
    units = fills.groupBy(*cell, unit).agg(F.greatest(F.least(F.round(F.avg(value), 9), F.lit(cap)), F.lit(-cap)).alias("x"))
    middle = units.groupBy(*cell).agg(F.percentile("x", F.lit(0.5)).alias("m"))
    joined = units.join(middle, list(cell))
    return joined.groupBy(*cell).agg(F.count(F.lit(1)).alias("units"), six(F.max("m")).alias("median"), six(F.percentile(F.abs(F.col("x") - F.col("m")), F.lit(0.5)) * 1.4826).alias("mad"), six(F.avg((F.col("x") > 0).cast("double"))).alias("positive"))


def breakdowns(rows: DataFrame, sets: Sequence[Sequence[str]], value: str) -> DataFrame:
    """Metrics over several dimensions in one pass."""
    names = sorted({c for s in sets for c in s})
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(F.count(F.lit(1)).alias("n"), six(F.avg(value)).alias("mean"))


def concentration(rows: DataFrame, dimension: str, value: str) -> DataFrame:
    """Each group's share of the absolute total: the total is a window over the groups, summed by range first."""
    g = rows.groupBy(dimension).agg(F.sum(value).alias("v"))
    return _with_total(g, {"t": F.abs("v")}).select(dimension, F.round("v", 3).alias("total"), six(F.abs("v") / F.col("t")).alias("share"))


def _with_total(groups: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Adds totals over all groups: summed in salted parts, then over those, and joined as one row."""
    salted = groups.groupBy(F.pmod(F.xxhash64(*groups.columns), F.lit(64)).alias("__s")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    total = salted.agg(F.lit(1).alias("__one"), *[F.sum(n).alias(n) for n in sums])
    return groups.withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one").drop("__one")


def leave_one_out(rows: DataFrame, dimension: str, value: str) -> DataFrame:
    """The mean without each group: totals less parts, not one pass for each group."""
    g = rows.groupBy(dimension).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    j = _with_total(g, {"ts": F.col("s"), "tn": F.col("n")})
    return j.select(dimension, six(F.try_divide(F.col("ts") - F.col("s"), F.col("tn") - F.col("n"))).alias("mean_without"))


def weighted_quantile(rows: DataFrame, by: Sequence[str], value: str, weight: str, q: float) -> DataFrame:
    """Positions (cumulative weight - w/2) / total with linear interpolation and clamped ends, over pre-summed equal values."""
    g = rows.groupBy(*by, F.col(value).alias("v")).agg(F.sum(weight).alias("w")).where("w > 0")
    w = Window.partitionBy(*by).orderBy("v")
    total = F.sum("w").over(Window.partitionBy(*by))
    g = g.withColumn("p", (F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("w") / 2) / total)
    g = g.withColumns({"pv": F.lag("v").over(w), "pp": F.lag("p").over(w), "nv": F.lead("v").over(w)})
    at = F.when((F.col("p") >= q) & F.col("pp").isNull(), F.col("v")).when((F.col("p") >= q) & (F.col("pp") < q), F.col("pv") + (F.col("v") - F.col("pv")) * (q - F.col("pp")) / (F.col("p") - F.col("pp"))).when((F.col("p") < q) & F.col("nv").isNull(), F.col("v"))
    return g.groupBy(*by).agg(six(F.max(at)).alias("quantile"))


def auc(rows: DataFrame, score: str, label: str, ranges: int = 256) -> DataFrame:
    """Rank AUC with ties at half, from counts by score. Scores are cut into ranges at approximate quantiles (a fixed number, told
    to all); each range runs its own sum, and the sums of the ranges before it are added: no task sorts all scores."""
    c = rows.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("n"))
    bounds = sorted(set(rows.agg(F.percentile_approx(F.col(score).cast("double"), [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []))
    c = c.withColumn("range", F.size(F.filter(F.array(*[F.lit(x) for x in bounds]).cast("array<double>"), lambda x: x < F.col("s"))))
    sums = c.groupBy("range").agg(F.sum("n").alias("own"))
    earlier = sums.select("range", F.coalesce(F.sum("own").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("inside", inside).join(F.broadcast(earlier), "range").withColumn("below", F.col("inside") + F.col("earlier"))
    return c.agg(six(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"))


def brier_logloss(rows: DataFrame, p: str, label: str) -> DataFrame:
    y, q = F.col(label), F.greatest(F.least(F.col(p), F.lit(1 - 1e-6)), F.lit(1e-6))
    return rows.agg(F.count(F.lit(1)).alias("n"), six(F.avg((q - y) * (q - y))).alias("brier"), six(F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))).alias("logloss"))


def calibration_error(rows: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins."""
    b = rows.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("p"), F.avg(label).alias("y"))
    return b.agg(six(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def benjamini_hochberg(tests: DataFrame, p: str, by: Sequence[str]) -> DataFrame:
    """Adjusted p: p * n / rank, then the running minimum from the largest, at most 1."""
    w = Window.partitionBy(*by)
    t = tests.withColumn("__r", F.row_number().over(w.orderBy(p, *[c for c in tests.columns if c not in (p, *by)]))).withColumn("__n", F.count(F.lit(1)).over(w))
    q = F.min(F.col(p) * F.col("__n") / F.col("__r")).over(w.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("adjusted", six(F.least(q, F.lit(1.0)))).drop("__r", "__n")
