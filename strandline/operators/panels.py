"""Panel joins that keep time: frozen admissions, lead targets, exact sessions, matched samples, events near events, alignments of labels, and ordered samples. No pair is made but inside an equality."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.windows import ordered, six
from strandline.operators.joins import asof, interval_join


def frozen_admission(opportunities: DataFrame, forecasts: DataFrame, keys: list[str], decided: str, frozen: str) -> DataFrame:
    """Opportunities with the forecast of their cell and session, one at most; unknown without one; a forecast frozen after the decision is an error."""
    n = forecasts.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(frozen).alias(frozen), F.first("state").alias("state"))
    j = opportunities.join(n, keys, "left")
    sound = F.when(F.col("__n") > 1, F.raise_error(F.lit("several forecasts for one cell")).cast("string")).when(F.col(frozen) > F.col(decided), F.raise_error(F.lit("forecast after the decision")).cast("string")).otherwise(F.coalesce("state", F.lit("unknown")))
    return j.withColumn("admission", sound).drop("__n", frozen, "state")


def synchronized_panel(grid: DataFrame, payoffs: DataFrame, keys: list[str]) -> DataFrame:
    """The whole eligibility grid with payoffs where there are any; what is absent stays missing."""
    return grid.join(payoffs, keys, "left")


def lead_targets(forecasts: DataFrame, outcomes: DataFrame, calendar: DataFrame, cell: str, session: str, leads: Sequence[int]) -> DataFrame:
    """Each forecast at several leads of the calendar, with the outcome of exactly that session: nothing is filled from another."""
    c = calendar.select(session).distinct().withColumn("__n", F.row_number().over(Window.orderBy(session)))
    f = forecasts.join(F.broadcast(c), session).withColumn("lead", F.explode(F.array(*[F.lit(k) for k in leads])))
    target = c.select(F.col(session).alias("target_session"), (F.col("__n")).alias("__t"))
    f = f.join(F.broadcast(target), F.col("__n") + F.col("lead") == F.col("__t"), "left").drop("__n", "__t")
    o = outcomes.select(F.col(cell), F.col(session).alias("target_session"), *[c for c in outcomes.columns if c not in (cell, session)])
    return f.join(o, [cell, "target_session"], "left")


def exact_interval_match(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, width: float, key: str) -> DataFrame:
    """Points with the one span that is open at them; why there is none or too many is told in order."""
    j = interval_join(points, spans, by, at, start, end, width)
    n = j.groupBy(key).agg(F.count(F.lit(1)).alias("matches"), F.first("span_id").alias("span_id"))
    out = points.join(n, key, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    reason = F.when(F.col("matches") == 0, "no_active_span").when(F.col("matches") > 1, "ambiguous_span").otherwise("matched")
    return out.withColumn("reason", reason).withColumn("span_id", F.when(F.col("matches") == 1, F.col("span_id")))


def previous_session(rows: DataFrame, facts: DataFrame, key: str, session: str, calendar: DataFrame) -> DataFrame:
    """Rows with the facts of exactly the session before in the calendar; older facts are refused as stale."""
    c = calendar.select(session).distinct().withColumn("required", F.lag(session).over(Window.orderBy(session)))
    r = rows.join(F.broadcast(c), session, "left")
    exact = facts.select(key, F.col(session).alias("required"), *[c for c in facts.columns if c not in (key, session)])
    latest = asof(r.select(key, session), facts.select(key, session), [key], [session], [], strict=True).select(key, session, F.col(f"asof_{session}").alias("actual")).distinct()
    j = r.join(exact, [key, "required"], "left").join(latest, [key, session], "left")
    status = F.when(F.col("required").isNull(), "no_previous_session").when(F.col("actual") == F.col("required"), "exact").when(F.col("actual").isNull(), "missing").otherwise("stale")
    return j.withColumn("status", status).drop("actual")


def hashed(columns: Sequence[str], seed: str) -> Column:
    """A seeded order: the same for the same rows wherever they are."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in columns]), 256)


def matched_random(tail: DataFrame, pool: DataFrame, cell: list[str], key: str, seed: str) -> DataFrame:
    """One different pool row for each tail row of the same cell, in seeded order: place against place, no pairs; tail rows beyond the pool stay without."""
    w = Window.partitionBy(*cell)
    t = tail.withColumn("__n", F.row_number().over(w.orderBy(hashed([key], seed + "t"))))
    p = pool.select(*cell, F.col(key).alias(f"match_{key}")).withColumn("__n", F.row_number().over(w.orderBy(hashed([f"match_{key}"], seed + "p"))))
    return t.join(p, [*cell, "__n"], "left").drop("__n")


def pseudo_sample(observed: DataFrame, eligible: DataFrame, cell: list[str], key: str, seed: str) -> DataFrame:
    """As many eligible rows of each cell as were observed there, none of the observed ones."""
    n = observed.groupBy(*cell).agg(F.count(F.lit(1)).alias("__want"))
    e = eligible.join(observed.select(key), key, "left_anti")
    e = e.withColumn("__n", F.row_number().over(Window.partitionBy(*cell).orderBy(hashed([key], seed))))
    return e.join(F.broadcast(n), cell).where(F.col("__n") <= F.col("__want")).drop("__n", "__want")


def nearest_other(events: DataFrame, at: list[str], order: str, symbol: str, key: str) -> DataFrame:
    """For each event the nearest one of the same state and bucket of another symbol (ties: the earlier, then by name): the last and
    the next event of other symbols, carried along the order, so that a bucket's events are never paired."""
    w = Window.partitionBy(*at).orderBy(order, key)
    me = F.struct(F.col(order).alias("o"), F.col(symbol).alias("s"), F.col(key).alias("k"))
    e = events.withColumn("__me", me)

    def other(frame) -> Column:
        """The last struct of the frame that belongs to another symbol: the last one, or the last before its symbol's run."""
        return F.last("__me", ignorenulls=True).over(frame)

    down = w.rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("__last", other(down))
    e = e.withColumn("__turn", F.when(F.col("__last.s") != F.col(symbol), F.col("__last")))
    e = e.withColumn("__before", F.coalesce(F.col("__turn"), F.last("__turn", ignorenulls=True).over(down)))
    up = Window.partitionBy(*at).orderBy(F.desc(order), F.desc(key)).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("__next", other(up))
    e = e.withColumn("__turn2", F.when(F.col("__next.s") != F.col(symbol), F.col("__next")))
    e = e.withColumn("__after", F.coalesce(F.col("__turn2"), F.last("__turn2", ignorenulls=True).over(up)))
    near = F.array_min(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.o") - F.col(order)).alias("d"), F.col(f"{c}.o").alias("o"), F.col(f"{c}.k").alias("k"))) for c in ("__before", "__after")])))
    return e.withColumn("__near", near).select(*[c for c in events.columns], F.col("__near.k").alias("nearest"), F.col("__near.d").alias("distance"))


def align_events(reference: DataFrame, candidate: DataFrame, by: list[str], at: str, family: str, key: str, tolerance: int) -> DataFrame:
    """Each reference event with the best candidate within a tolerance: the same family first, then the nearest, then the earlier; or none."""
    steps = F.explode(F.sequence(F.col(at) - tolerance, F.col(at) + tolerance))
    r = reference.withColumn("__at", steps)
    c = candidate.select(*by, F.col(at).alias("__at"), F.col(family).alias("__f"), F.col(key).alias("__k"))
    j = r.join(c, [*by, "__at"], "left").where("__k is not null")
    best = F.min_by(F.struct(F.col("__k").alias("candidate"), (F.col("__at") - F.col(at)).alias("shift"), (F.col("__f") == F.col(family)).alias("same_family")), F.struct((F.col("__f") != F.col(family)).cast("int"), F.abs(F.col("__at") - F.col(at)), F.col("__at"), F.col("__k")))
    g = j.groupBy(key).agg(best.alias("__b"))
    return reference.join(g, key, "left").select(*reference.columns, "__b.candidate", "__b.shift", "__b.same_family")


def compare_events(reference: DataFrame, candidate: DataFrame, by: list[str], at: str, shift: int) -> DataFrame:
    """Reference places that the other side has exactly, within a shift, or not; and candidate places that no reference is near to."""
    a, b = reference.select(*by, at).distinct(), candidate.select(*by, at).distinct()

    def near(x: DataFrame, y: DataFrame) -> DataFrame:
        spread = y.withColumn("__o", F.col(at)).withColumn(at, F.explode(F.sequence(F.col(at) - shift, F.col(at) + shift)))
        return x.join(spread.groupBy(*by, at).agg(F.min(F.abs(F.col("__o") - F.col(at))).alias("__d")), [*by, at], "left")

    kind = F.when(F.col("__d") == 0, "exact").when(F.col("__d").isNotNull(), "bounded_shift").otherwise("reference_only")
    left = near(a, b).select(*by, at, kind.alias("kind"))
    right = near(b, a).where("__d is null").select(*by, at, F.lit("candidate_only").alias("kind"))
    return left.unionByName(right)


def next_session_setups(rows: DataFrame, calendar: DataFrame, cell: list[str], session: str) -> DataFrame:
    """Whether the same setup is there again in the calendar's next session, only later, or not at all."""
    c = calendar.select(session).distinct().withColumn("__next", F.lead(session).over(Window.orderBy(session)))
    r = rows.select(*cell, session).distinct().withColumn("__own", F.lead(session).over(ordered(cell, [session]))).join(F.broadcast(c), session)
    kind = F.when(F.col("__next").isNull(), "calendar_end").when(F.col("__own") == F.col("__next"), "next_session").when(F.col("__own").isNotNull(), "later_session").otherwise("never_again")
    return r.select(*cell, session, kind.alias("availability"))


def align_labels(cost: Sequence[Sequence[float]]) -> list[int]:
    """The assignment of candidate labels to reference labels with the least total cost (the first of equal ones), for up to eight labels; the costs are a small matrix that both sides' centres give."""
    n = len(cost)
    if n > 8 or any(len(r) != n for r in cost):
        raise ValueError("a square matrix of up to eight labels is needed")
    return list(min(permutations(range(n)), key=lambda p: (sum(cost[i][p[i]] for i in range(n)), p)))


def label_costs(reference: DataFrame, candidate: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Squared distances between the centres of the labels of two sides: a few rows."""
    mean = lambda t, s: t.groupBy(F.col(label).alias(f"{s}_label")).agg(*[F.avg(c).alias(f"{s}_{c}") for c in columns])
    a, b = mean(reference, "a"), mean(candidate, "b")
    every = a.withColumn("__one", F.lit(1)).join(F.broadcast(b.withColumn("__one", F.lit(1))), "__one").drop("__one")
    return every.select("a_label", "b_label", six(sum((F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), 2) for c in columns), F.lit(0.0))).alias("cost"))


def latest_nomination(trades: DataFrame, nominations: DataFrame, family: str, at: str, value: str) -> DataFrame:
    """Each trade with the latest nomination of its family strictly before it."""
    return asof(trades, nominations.select(family, at, value), [family], [at], [value], strict=True)


def cosine_nearest(rows: DataFrame, query: Column, key: str, vector: str, label: str) -> DataFrame:
    """For each query row the most similar row of another label, over all rows: the queries are a stated set, sent in blocks to every part of the rows, and each part keeps its best."""
    unit = lambda v: F.transform(v, lambda x: x.cast("double"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    r = rows.select(key, label, unit(F.col(vector)).alias("v")).withColumn("n", norm(F.col("v")))
    q = rows.where(query).select(F.col(key).alias("q_key"), F.col(label).alias("q_label"), unit(F.col(vector)).alias("q")).withColumn("q_n", norm(F.col("q")))
    block = q.groupBy((F.col("q_key") % 16).alias("block")).agg(F.collect_list(F.struct("q_key", "q_label", "q", "q_n")).alias("qs"))
    dealt = r.withColumn("block", F.explode(F.array(*[F.lit(i) for i in range(16)]))).join(F.broadcast(block), "block")
    hit = dealt.withColumn("x", F.explode(F.filter("qs", lambda x: x["q_label"] != F.col(label)))).select(F.col("x.q_key").alias("q_key"), key, (F.aggregate(F.zip_with("v", F.col("x.q"), lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y) / (F.col("n") * F.col("x.q_n"))).alias("s"))
    best = hit.groupBy("q_key").agg(F.min_by(F.struct(key, "s"), F.struct(-F.round("s", 9), F.col(key))).alias("b"))
    return best.select("q_key", F.col(f"b.{key}").alias("nearest"), F.round("b.s", 5).alias("similarity"))


# ordered samples


def stride(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """Rows at an even stride through the order, about ``most``: positions by range first, so that no task numbers them all."""
    n = rows.count()
    step = max(1, n // most)
    r = rows.repartitionByRange(*order)
    part = r.withColumn("__p", F.spark_partition_id())
    counts = part.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    base = counts.select("__p", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    i = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return part.withColumn("__i", i).join(F.broadcast(base), "__p").where((F.col("__i") + F.col("__b")) % step == 0).drop("__p", "__i", "__b")


def round_robin(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """Up to so many rows, one of each group in turn."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("turn", k).orderBy("turn", group).limit(most)


def training_sample(rows: DataFrame, group: str, key: list[str], seed: str, per_group: int) -> DataFrame:
    """A bounded sample in seeded order, the same for the same rows."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(hashed(key, seed), *key))
    return rows.withColumn("__k", k).where(F.col("__k") <= per_group).drop("__k")


def retained(candidates: DataFrame, by: list[str], score: str, key: str, cap: int) -> DataFrame:
    """The best of each group by score, ties by key."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), key))
    return candidates.withColumn("rank", k).where(F.col("rank") <= cap)
