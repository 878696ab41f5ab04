"""As-of, interval, matched and paired joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], on: Sequence[str], values: Sequence[str], strict: bool = False) -> DataFrame:
    """For each left row the latest right row at or before it (strict: before), by a total order of columns that both have.
    Union, one shuffle on the key, one sort, one running last: no pairs are made."""
    value = F.struct(*[F.col(c) for c in [*on, *values]])
    first = F.lit(0 if strict else 1)
    a = left.select(*by, *on, first.alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(value.alias("x")).schema[0].dataType).alias("__r"))
    b = right.select(*by, *on, F.lit(1 if strict else 0).alias("__side"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), value.alias("__r"))
    w = Window.partitionBy(*by).orderBy(*on, "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where("__l is not null")
    return out.select("__l.*", *[F.col(f"__m.{c}").alias(f"asof_{c}") for c in [*on, *values]])


def prior_k(left: DataFrame, right: DataFrame, by: Sequence[str], on: Sequence[str], value: str, k: int = 2) -> DataFrame:
    """For each left row the last k right values strictly before it, newest first."""
    a = left.select(*by, *on, F.lit(0).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    b = right.select(*by, *on, F.lit(1).alias("__side"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), F.col(value).alias("__v"))
    both = a.unionByName(b)
    w = Window.partitionBy(*by).orderBy(*on, "__side")
    # the k-th last value: carried along the right rows first, so the frame holds one struct
    steps = both.where("__side = 1").withColumn("__last", F.array_compact(F.array(F.col("__v"), *[F.lag("__v", i).over(w) for i in range(1, k)])))
    merged = a.withColumn("__last", F.lit(None).cast(steps.schema["__last"].dataType)).unionByName(steps)
    out = merged.withColumn("__m", F.last("__last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__side = 0")
    return out.select("__l.*", *[F.get("__m", F.lit(i)).alias(f"prior_{i + 1}") for i in range(k)])


def interval_join(points: DataFrame, spans: DataFrame, by: Sequence[str], at: str, start: str, end: str, width: float, copies: bool = False) -> DataFrame:
    """Points with the spans that hold them (start <= at < end): spans are dealt over buckets of a width, so it stays an equi-join.
    With ``copies``, equal points and equal spans are joined once, as arrays, and all their pairs come from the arrays."""
    p, s = (_gathered(points, [*by, at], "__p"), _gathered(spans, [*by, start, end], "__s")) if copies else (points, spans)
    p = p.withColumn("__b", F.floor(F.col(at) / width))
    s = s.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    j = p.join(s, [*by, "__b"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("__b")
    if not copies:
        return j
    j = j.withColumn("__p", F.explode("__p")).withColumn("__s", F.explode("__s"))
    side = lambda df, x, keys: [F.col(c) if c in keys else F.col(f"{x}.{c}") for c in df.columns if c not in by]
    return j.select(*by, *side(points, "__p", [at]), *side(spans, "__s", [start, end]))


def _gathered(rows: DataFrame, keys: Sequence[str], name: str, most: int = 1024) -> DataFrame:
    """Rows of equal keys as arrays of their other columns, ``most`` at a time: one shuffle on the keys."""
    rest = [c for c in rows.columns if c not in keys]
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)) - 1
    r = rows.withColumn("__n", F.floor(n / most))
    return r.groupBy(*keys, "__n").agg(F.collect_list(F.struct(*rest) if rest else F.struct(F.lit(1))).alias(name)).drop("__n")


def matched_controls(treated: DataFrame, pool: DataFrame, strata: Sequence[str], order: Sequence[str], cap: int = 2) -> DataFrame:
    """Controls by exact strata, dealt one after another in order: rank against rank, so no treated x pool pairs are made.
    The i-th treated row of a cell gets the controls of rank (i-1)*cap+1 to i*cap; each control is used once."""
    w = Window.partitionBy(*strata).orderBy(*order)
    t = treated.withColumn("__slot", F.row_number().over(w) - 1)
    c = pool.select(*strata, *[F.col(x).alias(f"control_{x}") for x in order])
    c = c.withColumn("__r", F.row_number().over(Window.partitionBy(*strata).orderBy(*[f"control_{x}" for x in order])) - 1).withColumn("__slot", F.floor(F.col("__r") / cap)).drop("__r")
    return t.join(c, [*strata, "__slot"]).drop("__slot")


def paired(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join with the side each key is on."""
    a, b = left.withColumn("__a", F.lit(True)), right.withColumn("__b", F.lit(True))
    side = F.when(F.col("__a").isNull(), "right_only").when(F.col("__b").isNull(), "left_only").otherwise("both")
    return a.join(b, list(keys), "full_outer").withColumn("side", side).drop("__a", "__b")
