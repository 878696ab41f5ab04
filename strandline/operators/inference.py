"""Tests, resampling and nulls. Draws come from hashes of what is drawn, not from a generator, so a lost executor draws the same again and SQL can say the same. What is resampled are session values: a cell's array is as long as its calendar, whatever the number of rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.windows import before, six

SCALE = float(1 << 48)


def drawn(*parts: Column) -> Column:
    """A whole number below 2 to the 48th, from the hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    return drawn(*parts) / F.lit(SCALE)


def empirical_p(observed: DataFrame, draws: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One more than the draws that reach the observed value, over one more than all draws."""
    j = draws.select(*keys, F.col(value).alias("__d")).join(observed.select(*keys, F.col(value).alias("__o")), keys)
    return j.groupBy(*keys).agg(six((F.sum((F.col("__d") >= F.col("__o")).cast("long")) + 1) / (F.count("__d") + 1)).alias("p"))


def holm(tests: DataFrame, p: str, by: Sequence[str]) -> DataFrame:
    """Step-down adjustment in each family of tests: p times the tests left, never less than before, at most 1."""
    order = [p, *[c for c in tests.columns if c not in (p, *by)]]
    w = Window.partitionBy(*by)
    t = tests.withColumns({"__r": F.row_number().over(w.orderBy(*order)), "__n": F.count(F.lit(1)).over(w)})
    up = F.max(F.col(p) * (F.col("__n") - F.col("__r") + 1)).over(w.orderBy("__r").rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("adjusted", six(F.least(up, F.lit(1.0)))).drop("__r", "__n")


def one_sided_p(values: DataFrame, by: list[str], value: str, steps: int = 400) -> DataFrame:
    """The probability, under no effect, of a mean at least as large (Student's t): an integral over the angle, so no library is needed."""
    g = values.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    h = pi / steps
    # cos(a)^(n - 2) over [-pi/2, pi/2], and over the part above the observed angle
    angle = F.atan(F.col("m") / (F.col("s") / F.sqrt("n")) / F.sqrt(F.col("n") - 1))
    whole = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0.0), lambda a, i: a + F.pow(F.cos(F.lit(-pi / 2) + (i + 0.5) * h), F.col("n") - 2) * h)
    above = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0.0), lambda a, i: a + F.pow(F.cos(F.col("angle") + (i + 0.5) * (F.lit(pi / 2) - F.col("angle")) / steps), F.col("n") - 2) * (F.lit(pi / 2) - F.col("angle")) / steps)
    p = F.when(F.col("n") < 2, 1.0).when(F.col("s") == 0, F.when(F.col("m") > 0, 0.0).otherwise(1.0)).otherwise(F.round(above / whole, 5))
    return g.withColumn("angle", F.when((F.col("n") > 1) & (F.col("s") > 0), angle)).select(*by, "n", p.alias("p"))


def block_draws(sessions: DataFrame, by: list[str], order: str, value: str, resamples: int, block: int) -> DataFrame:
    """Means of resampled blocks of consecutive sessions (going round), one a draw; cells are resampled apart. One array a cell, its draws spread over the cluster."""
    cells = sessions.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("v")).withColumn("n", F.size("v"))
    d = cells.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    starts = F.transform(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1), lambda k: drawn(*[F.col(c) for c in by], F.col("draw"), k) % F.col("n"))
    taken = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.element_at("v", ((F.element_at(F.col("starts"), (F.floor(i / block) + 1).cast("int")) + i % block) % F.col("n") + 1).cast("int")))
    d = d.withColumn("starts", starts).withColumn("taken", taken)
    return d.select(*by, "draw", F.aggregate("taken", F.lit(0.0), lambda a, x: a + x).alias("total"), "n")


def block_bootstrap(rows: DataFrame, by: list[str], session: str, value: str, resamples: int, block: int) -> DataFrame:
    """The mean of session means and its 95 % interval by blocks of sessions, resampled inside each cell and pooled over the cells of a draw."""
    s = rows.groupBy(*by, session).agg(F.avg(value).alias("__m"))
    draws = block_draws(s, by, session, "__m", resamples, block).groupBy("draw").agg((F.sum("total") / F.sum("n")).alias("mean"))
    observed = s.agg(six(F.avg("__m")).alias("observed"))
    return observed.crossJoin(F.broadcast(draws.agg(six(F.percentile("mean", 0.025)).alias("low"), six(F.percentile("mean", 0.975)).alias("high"))))  # one row each


def ratio_bootstrap(rows: DataFrame, by: list[str], session: str, top: str, bottom: str, resamples: int, block: int) -> DataFrame:
    """The level at which a total breaks even (the sum of one column over that of another) and its 95 % interval by blocks of sessions."""
    s = rows.groupBy(*by, session).agg(F.sum(top).alias("t"), F.sum(bottom).cast("double").alias("b"))
    keys = [*by, "draw"]
    both = block_draws(s, by, session, "t", resamples, block).select(*keys, F.col("total").alias("t")).join(block_draws(s, by, session, "b", resamples, block).select(*keys, F.col("total").alias("b")), keys)
    level = both.groupBy(*by).agg(six(F.percentile(F.try_divide("t", "b"), 0.025)).alias("low"), six(F.percentile(F.try_divide("t", "b"), 0.975)).alias("high"))
    return s.groupBy(*by).agg(six(F.try_divide(F.sum("t"), F.sum("b"))).alias("level")).join(level, by)


def session_draws(sessions: DataFrame, session: str, draws: int) -> DataFrame:
    """How often each session is taken in each draw of as many whole sessions, with replacement."""
    s = sessions.select(session).distinct().withColumn("__i", F.row_number().over(Window.orderBy(session)) - 1)  # a calendar
    n = F.count(F.lit(1)).over(Window.partitionBy())
    d = s.withColumn("__n", n).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    hit = d.select("draw", (drawn(F.lit("session"), F.col("draw"), F.col("__i")) % F.col("__n")).alias("__i"))
    return hit.groupBy("draw", "__i").agg(F.count(F.lit(1)).alias("times")).join(s, "__i").drop("__i")


def permuted(rows: DataFrame, slate: list[str], identity: str, bundle: list[str], seed: int) -> DataFrame:
    """A bundle of columns handed round among the rows of each slate, whole: the row of a rank takes the bundle of the row whose hash has it."""
    w = Window.partitionBy(*slate)
    a = rows.withColumn("__r", F.row_number().over(w.orderBy(identity))).drop(*bundle)
    b = rows.select(*slate, *bundle, F.row_number().over(w.orderBy(drawn(F.lit(seed), F.col(identity)), identity)).alias("__r"))
    return a.join(b, [*slate, "__r"]).drop("__r")


def shifted_sessions(rows: DataFrame, by: list[str], session: str, ordinal: str, values: list[str], draw: int) -> DataFrame:
    """Whole sessions' values moved round the calendar by a drawn number of sessions, place by place; null where the source session has no such place."""
    s = rows.select(*by, session).distinct()
    w = Window.partitionBy(*by)
    s = s.withColumns({"__i": F.row_number().over(w.orderBy(session)) - 1, "__n": F.count(F.lit(1)).over(w)})
    s = s.withColumn("__s", F.when(F.col("__n") > 1, 1 + drawn(*[F.col(c) for c in by], F.lit(draw)) % (F.col("__n") - 1)).otherwise(0))
    places = s.select(*by, session, ((F.col("__i") + F.col("__s")) % F.col("__n")).alias("__from"))
    source = rows.join(s.select(*by, session, F.col("__i").cast("long").alias("__from")), [*by, session]).select(*by, "__from", ordinal, *values)
    return rows.drop(*values).join(places, [*by, session]).join(source, [*by, "__from", ordinal], "left").drop("__from")


def phase_block_null(rows: DataFrame, by: list[str], phase: str, order: str, value: str, block: int, seed: int) -> DataFrame:
    """Increments replaced by drawn blocks of increments of the same series and clock phase; a block that runs over the end goes on at the start."""
    w = Window.partitionBy(*by, phase)
    t = rows.withColumns({"__i": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count(F.lit(1)).over(w)})
    blocks = F.ceil(F.col("__n") / block)
    source = (drawn(*[F.col(c) for c in by], F.col(phase), F.lit(seed), F.floor(F.col("__i") / block)) % blocks) * block + F.col("__i") % block
    t = t.withColumn("__from", (source % F.col("__n")).cast("int"))
    return t.drop(value).join(t.select(*by, phase, F.col("__i").alias("__from"), F.col(value)), [*by, phase, "__from"]).drop("__i", "__n", "__from")


def pair_shift_null(rows: DataFrame, by: list[str], order: str, a: str, b: str, resamples: int) -> DataFrame:
    """The mean product of two series of each pair, against the same with one of them moved round by drawn shifts: observed, and the share of draws that reach it. One array a pair; its length is the pair's calendar."""
    g = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, a, b))).alias("l")).withColumn("n", F.size("l")).where("n > 2")
    x = g.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(resamples))))
    shift = F.when(F.col("draw") == 0, F.lit(0).cast("long")).otherwise(1 + drawn(*[F.col(c) for c in by], F.col("draw")) % (F.col("n") - 1))
    x = x.withColumn("s", shift)
    total = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0.0), lambda t, i: t + F.element_at("l", i + 1)[a] * F.element_at("l", ((i + F.col("s")) % F.col("n") + 1).cast("int"))[b])
    x = x.select(*by, "draw", F.round(total / F.col("n"), 9).alias("v"))
    o = F.max(F.when(F.col("draw") == 0, F.col("v"))).over(Window.partitionBy(*by))
    return x.withColumn("o", o).groupBy(*by).agg(six(F.first("o")).alias("observed"), six(F.sum((F.col("v") >= F.col("o")).cast("long")) / (resamples + 1)).alias("p"))


def path_counts(states: DataFrame, by: list[str], order: str, state: str, candidates: DataFrame) -> DataFrame:
    """How often each candidate path of states (an array of two or more) stands in the sessions, and how often a first-order chain would show it: its starts with room for it, times its steps' probabilities."""
    w = Window.partitionBy(*by).orderBy(order)
    longest = 4
    # leads are bounded frames; a count of all rows to come would be read anew at each row
    s = states.select(F.array(*[F.lead(state, k).over(w) for k in range(longest)]).alias("__path"), sum((F.coalesce(F.lead(F.lit(1), k).over(w), F.lit(0)) for k in range(1, longest)), F.lit(1)).alias("__left"))
    windows = s.groupBy("__path", "__left").agg(F.count(F.lit(1)).alias("__n"))
    # every window of each length, counted before it meets the candidates
    grams = windows.where("__left > 1").select(F.explode(F.transform(F.sequence(F.lit(2), F.col("__left")), lambda k: F.slice("__path", 1, k))).alias("path"), "__n").groupBy("path").agg(F.sum("__n").alias("count"))
    moves = grams.where(F.size("path") == 2).select(F.col("path")[0].alias("a"), F.col("path")[1].alias("b"), F.col("count").alias("n"))
    moves = moves.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("a")))
    starts = grams.groupBy(F.col("path")[0].alias("first"), F.size("path").alias("length")).agg(F.sum("count").alias("starts"))
    c = candidates.select("path", F.col("path")[0].alias("first"), F.size("path").alias("length"))
    steps = c.select("path", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("i", "a")).withColumn("b", F.element_at("path", F.col("i") + 2))
    chance = steps.join(moves, ["a", "b"], "left").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("p", F.lit(0.0)).alias("p")))).alias("__steps"))
    out = c.join(grams, "path", "left").join(starts, ["first", "length"], "left").join(chance, "path")
    expected = F.aggregate("__steps", F.coalesce("starts", F.lit(0)).cast("double"), lambda t, x: t * x["p"])
    return out.select("path", F.coalesce("count", F.lit(0)).alias("count"), six(expected).alias("expected"))


def simulated(sessions: DataFrame, key: list[str], length: str, first: Mapping[int, float], moves: Mapping[int, Mapping[int, float]], draws: int) -> DataFrame:
    """Sessions of states drawn from a first-order chain: each is folded from hashes of its key, draw and place; columns draw and chain."""
    def pick(p: Mapping[int, float], u: Column) -> Column:
        out, at, states = None, 0.0, sorted(p)
        for s in states[:-1]:
            at += p[s]
            out = F.when(u < at, s) if out is None else out.when(u < at, s)
        return F.lit(states[-1]) if out is None else out.otherwise(states[-1])

    d = sessions.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = lambda i: uniform(*[F.col(c) for c in key], F.col("draw"), i)
    step = lambda last, i: reduce(lambda e, s: F.when(last == s, pick(moves[s], u(i))).otherwise(e), sorted(moves), F.lit(None).cast("int"))
    begin = F.array(pick(first, u(F.lit(0))))
    chain = F.aggregate(F.sequence(F.lit(1), F.col(length) - 1), begin, lambda a, i: F.concat(a, F.array(step(F.element_at(a, -1), i))))
    return d.withColumn("chain", F.when(F.col(length) > 1, chain).otherwise(begin))


def _places(path: Sequence[int], length: Column) -> Column:
    """Where a path starts in a drawn chain, no further than its first states."""
    want = F.array(*[F.lit(s) for s in path])
    last = F.least(F.size("chain"), length) - len(path) + 1
    return F.when(last >= 1, F.filter(F.sequence(F.lit(1), last), lambda i: F.slice("chain", i, len(path)) == want)).otherwise(F.array().cast("array<int>"))


def simulated_counts(sessions: DataFrame, key: list[str], length: str, first: Mapping[int, float], moves: Mapping[int, Mapping[int, float]], path: Sequence[int], draws: int) -> DataFrame:
    """Counts of a path in drawn sessions, one a draw."""
    d = simulated(sessions, key, length, first, moves, draws)
    return d.groupBy("draw").agg(F.sum(F.size(_places(path, F.size("chain")))).alias("count"))


def simulated_first_events(sessions: DataFrame, key: list[str], length: str, first: Mapping[int, float], moves: Mapping[int, Mapping[int, float]], candidates: Mapping[str, Sequence[int]], horizon: int, draws: int) -> DataFrame:
    """In how many drawn sessions each candidate path is the first to be complete within a horizon (at a tie the first by name), one row a draw and candidate, and `none`."""
    d = simulated(sessions, key, length, first, moves, draws)
    ends = [F.struct((F.array_min(_places(p, F.lit(horizon))) + len(p) - 1).alias("at"), F.lit(n).alias("name")) for n, p in sorted(candidates.items())]
    done = F.array_min(F.filter(F.array(*ends), lambda x: x["at"].isNotNull()))
    return d.groupBy("draw", F.coalesce(done["name"], F.lit("none")).alias("first")).agg(F.count(F.lit(1)).alias("sessions"))


def random_same_count(rows: DataFrame, by: list[str], identity: str, kept: Column, value: str, draws: int) -> DataFrame:
    """What as many rows picked at random would give: the median over draws of the picks' median and of their share of gains, next to the kept rows' own."""
    r = rows.withColumn("__k", kept.cast("int")).withColumn("__n", F.sum("__k").over(Window.partitionBy(*by)))
    own = r.where("__k = 1").groupBy(*by).agg(F.count(F.lit(1)).alias("kept"), six(F.percentile(value, 0.5)).alias("median"), six(F.avg((F.col(value) > 0).cast("double"))).alias("win"))
    d = r.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    w = Window.partitionBy(*by, "draw").orderBy(drawn(F.col("draw"), F.col(identity)), identity)
    picks = d.withColumn("__r", F.row_number().over(w)).where("__r <= __n").groupBy(*by, "draw").agg(F.percentile(value, 0.5).alias("m"), F.avg((F.col(value) > 0).cast("double")).alias("g"))
    return own.join(picks.groupBy(*by).agg(six(F.percentile("m", 0.5)).alias("random_median"), six(F.percentile("g", 0.5)).alias("random_win")), by)


def blocker_quality(rows: DataFrame, by: list[str], kept: Column, value: str) -> DataFrame:
    """How many losses and how many gains a blocker catches, and the median it leaves against all."""
    v, k = F.col(value), F.coalesce(kept, F.lit(False))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.groupBy(*by).agg(n(k).alias("kept"), six(F.try_divide(n(k & (v <= 0)), n(v <= 0))).alias("capture"), six(F.try_divide(n(k & (v > 0)), n(v > 0))).alias("false_block"), six(F.percentile(v, 0.5) - F.percentile(F.when(k, v), 0.5)).alias("improvement"))


def role_rows(rows: DataFrame, by: list[str], kept: Column, value: str, direction: Column) -> DataFrame:
    """Medians, wins and wrong ways of returns turned to the expected direction, before and after a filter."""
    k = F.coalesce(kept, F.lit(False))
    a = F.col(value) * direction
    after = F.when(k, a)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(k).alias("kept"), six(F.percentile(value, 0.5)).alias("raw_before"), six(F.percentile(F.when(k, F.col(value)), 0.5)).alias("raw_after"), six(F.percentile(a, 0.5)).alias("aligned_before"), six(F.percentile(after, 0.5)).alias("aligned_after"), six(F.avg((a > 0).cast("int"))).alias("win_before"), six(F.avg((after > 0).cast("int"))).alias("win_after"), six(F.avg((after < 0).cast("int"))).alias("wrong_way"))


def threshold_filters(rows: DataFrame, train: Column, features: Sequence[str], value: str, quantiles: Sequence[float], least: float, top: int) -> DataFrame:
    """Rules `feature <= t` and `feature >= t` at train quantiles, scored by the train mean of what they keep over that of all; the best `top` singles, then AND and OR of their pairs. Each stage is one pass over the rows with conditional sums, whatever the number of rules; the rules and scores that meet the driver are as many as the settings say."""
    t = rows.where(train)
    cuts = t.agg(*[F.percentile(f, [float(q) for q in quantiles]).alias(f) for f in features]).first()
    singles = {f"{f} {op} {q}": (F.col(f) <= c if op == "<=" else F.col(f) >= c) for f in features for q, c in zip(quantiles, cuts[f]) for op in ("<=", ">=")}

    def scores(rules: dict[str, Column]) -> DataFrame:
        x = [F.struct(F.lit(n).alias("rule"), F.count_if(c).alias("kept"), six(F.avg(F.when(c, F.col(value))) - F.avg(value)).alias("score"), F.count(F.lit(1)).alias("n")) for n, c in rules.items()]
        s = t.agg(F.array(*x).alias("a")).select(F.explode("a").alias("x")).select("x.*")
        return s.where(F.col("kept") >= least * F.col("n")).drop("n")

    best = scores(singles)
    names = [r.rule for r in best.orderBy(F.desc("score"), "rule").limit(top).select("rule").collect()]  # the settings bound it
    pairs = {f"({a}) {word} ({b})": (singles[a] & singles[b] if word == "AND" else singles[a] | singles[b]) for i, a in enumerate(names) for b in names[i + 1 :] for word in ("AND", "OR")}
    return best.unionByName(scores(pairs)) if pairs else best


def equality_rules(rows: DataFrame, features: Sequence[str], least: int) -> DataFrame:
    """Rules of one to three equal conditions on binned features with enough support: one pass of grouping sets."""
    from itertools import combinations

    names = sorted(features)
    sets = [list(c) for k in (1, 2, 3) for c in combinations(names, k)]
    g = rows.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(F.count(F.lit(1)).alias("support"), F.grouping_id(*names).alias("__g"))
    bit = lambda i: F.col("__g").bitwiseAND(1 << (len(names) - 1 - i)) == 0
    text = F.concat_ws(" and ", *[F.when(bit(i), F.concat(F.lit(f"{n} == "), F.col(n).cast("string"))) for i, n in enumerate(names)])
    size = sum((F.when(bit(i), 1).otherwise(0) for i in range(len(names))), F.lit(0))
    return g.where(F.col("support") >= least).select(text.alias("rule"), size.alias("conditions"), "support")


def tree_leaves(rows: DataFrame, features: Sequence[str], label: str, depth: int = 3, least: int = 20) -> DataFrame:
    """Leaves of a shallow tree on binned features (whole numbers), grown level by level: one aggregate over all rows and features gives every split of a level; the choices are at most 2 to the depth rows."""
    node = F.lit("")
    for _ in range(depth):
        long = rows.withColumn("__node", node).select("__node", F.col(label).alias("__y"), F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("long").alias("v")) for f in sorted(features)])).alias("x")).where("__node is not null and x.v is not null")
        h = long.groupBy("__node", "x.f", "x.v").agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("y"))
        w, up = Window.partitionBy("__node", "f"), Window.partitionBy("__node", "f").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        h = h.withColumns({"ln": F.sum("n").over(up), "ly": F.sum("y").over(up), "tn": F.sum("n").over(w), "ty": F.sum("y").over(w)}).withColumns({"rn": F.col("tn") - F.col("ln"), "ry": F.col("ty") - F.col("ly")}).where((F.col("ln") >= least) & (F.col("rn") >= least))
        gini = lambda n, y: F.col(y) * (1 - F.col(y) / F.col(n))
        gain = F.round(gini("tn", "ty") - gini("ln", "ly") - gini("rn", "ry"), 9)
        best = h.withColumn("gain", gain).where("gain > 0").groupBy("__node").agg(F.max_by(F.struct("f", "v"), F.struct("gain", -F.col("v"), "f")).alias("b")).select("__node", "b.*").collect()
        if not best:
            break
        old = node
        for b in sorted(best, key=lambda r: r["__node"]):
            name = b["__node"] + " and " if b["__node"] else ""
            split = F.when(F.col(b.f) <= b.v, f"{name}{b.f} <= {b.v}").when(F.col(b.f) > b.v, f"{name}{b.f} > {b.v}")
            node = F.when(old == b["__node"], split).otherwise(node)
    return rows.groupBy(node.alias("leaf")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("positives"))


def apply_rulebook(events: DataFrame, keys: list[str], rules: Sequence[Mapping], default: str = "unmatched") -> DataFrame:
    """The rules of a rulebook whose conditions an event meets, one row each; events that meet none once, under the default. A rule: name, and conditions of feature, op, value."""
    ops = {"<=": Column.__le__, ">=": Column.__ge__, "<": Column.__lt__, ">": Column.__gt__, "==": Column.__eq__, "!=": Column.__ne__}
    met = [F.when(F.coalesce(reduce(Column.__and__, [ops[o](F.col(f), F.lit(v)) for f, o, v in r["when"]]), F.lit(False)), r["name"]) for r in rules]
    hits = F.array_compact(F.array(*met))
    return events.select(*keys, F.explode(F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(default)))).alias("rule"))


def controller(long: Column, short: Column, allowed: Column, worth: Column) -> Column:
    """One rule, one vote: a side only if movement is allowed, votes don't conflict and the conservative value is positive."""
    out = lambda s, r: F.struct(F.lit(s).alias("state"), F.lit(r).alias("reason"))
    side = F.when(long > 0, out("LONG", "supported_directional_vote")).otherwise(out("SHORT", "supported_directional_vote"))
    return F.when(~allowed, out("NEUTRAL", "movement_permission_failed")).when((long > 0) & (short > 0), out("NEUTRAL", "conflicting_votes")).when((long == 0) & (short == 0), out("NEUTRAL", "no_directional_vote")).when(~worth, out("NEUTRAL", "non_positive_conservative_value")).otherwise(side)


def dedupe_trades(signals: DataFrame, stock: str, time: str, session: str, score: str, identity: str) -> DataFrame:
    """The best signal of a stock and time; of a stock's session only the first is traded, the others are missed."""
    one = signals.withColumn("__r", F.row_number().over(Window.partitionBy(stock, session, time).orderBy(F.desc(score), identity))).where("__r = 1").drop("__r")
    first = F.row_number().over(Window.partitionBy(stock, session).orderBy(time)) == 1
    return one.withColumn("outcome", F.when(first, "trade").otherwise("one_trade_per_symbol_session"))


def out_of_sample(rows: DataFrame, train: Column, state: str, value: str) -> DataFrame:
    """A state's direction learned on the train rows, how often the test rows go that way, and the same for all states together."""
    way = lambda m: F.signum(m).cast("int")
    r = rows.withColumn("__t", train)
    med = lambda c: F.percentile(F.when(c, F.col(value)), 0.5)
    own = r.groupBy(state).agg(F.count_if("__t").alias("train"), F.count_if(~F.col("__t")).alias("test"), six(med(F.col("__t"))).alias("train_median"), six(med(~F.col("__t"))).alias("test_median"), F.avg(F.when(~F.col("__t"), (F.col(value) > 0).cast("int"))).alias("__up"), F.avg(F.when(~F.col("__t"), (F.col(value) < 0).cast("int"))).alias("__down"))
    every = r.agg(med(F.col("__t")).alias("__gm"), F.avg(F.when(~F.col("__t"), (F.col(value) > 0).cast("int"))).alias("__gu"), F.avg(F.when(~F.col("__t"), (F.col(value) < 0).cast("int"))).alias("__gd"))
    j = own.crossJoin(F.broadcast(every))  # one row
    right = lambda m, up, down: F.when(F.col(m) > 0, F.col(up)).when(F.col(m) < 0, F.col(down))
    return j.where("train > 0 and test > 0").select(state, "train", "test", "train_median", "test_median", way(F.col("train_median")).alias("direction"), six(right("train_median", "__up", "__down")).alias("accuracy"), six(right("__gm", "__gu", "__gd")).alias("generic_accuracy"))


def monthly_walk_forward(rows: DataFrame, month: str, feature: str, value: str, edges: Sequence[float], least: int) -> DataFrame:
    """Each month admits the feature's bins whose mean over all months before is positive and supported: sums a month and bin, then a running sum over the months, so no month is rescanned."""
    bin_ = sum((F.when(F.col(feature) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    g = rows.groupBy(month, bin_.alias("bin")).agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    w = before(["bin"], [month])
    g = g.withColumns({"__n": F.coalesce(F.sum("n").over(w), F.lit(0)), "__s": F.coalesce(F.sum("s").over(w), F.lit(0.0))})
    g = g.withColumn("__in", (F.col("__n") >= least) & (F.col("__s") > 0))
    return g.groupBy(month).agg(F.sum("n").alias("events"), F.sum(F.when(F.col("__in"), F.col("n")).otherwise(0)).alias("traded"), six(F.sum(F.when(F.col("__in"), F.col("s")))).alias("net"))


def monthly_rule_choice(rows: DataFrame, month: str, rule: str, value: str, least: int) -> DataFrame:
    """Each month replays the rule with the best mean over all months before (at a tie the first by name), if any has the support: sums a month and rule, then running sums."""
    g = rows.groupBy(month, rule).agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    months, rules = g.select(month).distinct(), g.select(rule).distinct()
    # a rule without a row in a month keeps its past: the grid is as large as the calendar times the rules
    grid = months.withColumn("__one", F.lit(1)).join(F.broadcast(rules.withColumn("__one", F.lit(1))), "__one").drop("__one").join(g, [month, rule], "left")
    w = before([rule], [month])
    grid = grid.withColumns({"__n": F.coalesce(F.sum("n").over(w), F.lit(0)), "__s": F.sum("s").over(w)})
    ranked = grid.where((F.col("__n") >= least) & F.col("__s").isNotNull()).groupBy(month).agg(F.min(F.struct((-F.round(F.col("__s") / F.col("__n"), 9)).alias("m"), F.col(rule).alias("rule"), F.coalesce("n", F.lit(0)).alias("n"), F.col("s").alias("s"))).alias("b"))
    return months.join(ranked, month, "left").select(month, F.col("b.rule").alias("rule"), F.coalesce("b.n", F.lit(0)).alias("trades"), six("b.s").alias("net"))


def prequential_hazards(rows: DataFrame, family: list[str], session: str, cause: str, causes: Sequence[str], prior: float) -> DataFrame:
    """Online hazards of competing causes: before each session of a family, each cause's count so far over the sessions so far, with a prior for each; a session with no cause counts as at risk only."""
    w = before(family, [session])
    at_risk = F.count(F.lit(1)).over(w)
    rates = [six((F.coalesce(F.sum((F.col(cause) == c).cast("int")).over(w), F.lit(0)) + prior) / (at_risk + prior * (len(causes) + 1))).alias(f"hazard_{c}") for c in causes]
    return rows.select(*family, session, at_risk.alias("at_risk"), *rates)


def grouped_importance(rows: DataFrame, slate: list[str], identity: str, groups: Mapping[str, list[str]], score: Column, label: str, seed: int) -> DataFrame:
    """By how much the Brier score of a frozen model worsens when a group of its features is handed round inside the slates."""
    brier = lambda df, n: df.agg(F.avg(F.pow(score - F.col(label), 2)).alias(n))
    base = brier(rows, "__b")
    parts = [brier(permuted(rows, slate, identity, cols, seed), "__p").select(F.lit(name).alias("group"), "__p") for name, cols in groups.items()]
    return reduce(DataFrame.unionByName, parts).crossJoin(F.broadcast(base)).select("group", six(F.col("__p") - F.col("__b")).alias("importance"))
