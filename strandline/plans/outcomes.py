"""Queries of forward outcomes over hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.windows import forward, ordered
from strandline.operators import events, outcomes
from strandline.plans.registry import H, RUNS, W, query, table
from strandline.sources import bars

SESSION = ["symbol", "session"]


def path(last: int, first: int = 1, columns: str = "{'i': bar_index, 'o': open, 'h': high, 'l': low, 'c': close}") -> str:
    """SQL: x with p (the bars from first to last rows on) and whole."""
    n = last - first + 1
    a = f"{first} FOLLOWING" if first else "CURRENT ROW"
    return f", x0 AS (SELECT *, list({columns}) {W} ROWS BETWEEN {a} AND {last} FOLLOWING) AS p FROM b), x AS (SELECT *, coalesce(len(p) = {n} AND p[{n}].i = bar_index + {last} AND p[1].i = bar_index + {first}, false) AS whole FROM x0)"


MULT = {"1_0": 1.0, "1_5": 1.5, "2_0": 2.0}
CO = H + path(3, 0).replace("ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING", "ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING").replace("len(p) = 4 AND p[4].i = bar_index + 3", "len(p) = 3 AND p[3].i = bar_index + 2")
CO += ", y AS (SELECT *, 6.0 * sqrt(180 / 98280.0::DOUBLE) AS sg, list_transform(p, lambda z: ln(z.h / open)) AS up, list_transform(p, lambda z: ln(z.l / open)) AS dn, ln(p[3].c / open) AS r FROM x), z AS (SELECT *, list_max(up) AS mu, list_min(dn) AS md, greatest(list_max(up), abs(list_min(dn))) AS be FROM y)"
CO += ", k AS (SELECT *, " + ", ".join(f"list_min(list_filter(range(1, 4), lambda i: up[i] > {m} * sg OR abs(dn[i]) > {m} * sg)) AS t_{n}" for n, m in MULT.items()) + " FROM z)"
CO_SELECT = " SELECT symbol, session, bar_index, " + ", ".join(
    f"CASE WHEN whole THEN {c} END AS {n}"
    for n, c in {
        "signed_return": "round(r, 6)", "exceeds": "abs(r) > sg * sqrt(2 / pi())", "max_up": "round(mu, 6)", "max_down": "round(md, 6)", "time_up": "CAST(list_position(up, mu) AS INT)", "time_down": "CAST(list_position(dn, md) AS INT)", "path_range": "round(ln(list_max(list_transform(p, lambda z: z.h)) / list_min(list_transform(p, lambda z: z.l))), 6)", "sigma_ratio": "round(be / (sg + 1e-12), 4)",
        "crossed": "len(list_filter(p, lambda z: z.h > open)) > 0 AND len(list_filter(p, lambda z: z.l < open)) > 0", "reverted": "be / (sg + 1e-12) >= 1.5 AND abs(r) <= 0.5 * be",
    }.items()
)
CO_SELECT += ", " + ", ".join(f"CASE WHEN whole THEN CAST(t_{n} AS INT) END AS time_{n}, CASE WHEN whole THEN CASE WHEN t_{n} IS NULL THEN 'none' WHEN up[t_{n}] > {m} * sg AND abs(dn[t_{n}]) > {m} * sg THEN 'both' WHEN up[t_{n}] > {m} * sg THEN 'up' ELSE 'down' END END AS side_{n}, CASE WHEN whole THEN t_{n} IS NOT NULL AND abs(r) <= {m} * sg END AS back_{n}" for n, m in MULT.items()) + " FROM k"


@query(CO + CO_SELECT)
def checkpoint_outcomes(spark, d):
    return outcomes.checkpoint_outcomes(bars.hourly(spark, d), 3, F.lit(6.0))


DT = H + path(4) + f", s AS (SELECT x.*, p[1].o AS en, ln(close / first_value(open) {W})) AS bf, ln(p[1].o / close) AS gp FROM x)"


@query(DT + " SELECT symbol, session, bar_index, round(bf, 6) AS before, round(gp, 6) AS gap, " + ", ".join(f"round(ln(p[{h}].c / en), 6) AS return_{h}, round(greatest(list_max(list_transform(p[1:{h}], lambda z: ln(z.h / en))), 0), 6) AS up_{h}, round(greatest(list_max(list_transform(p[1:{h}], lambda z: ln(en / z.l))), 0), 6) AS down_{h}, CASE WHEN p[{h}].c <> en THEN CASE WHEN p[{h}].c > en THEN 1 ELSE 0 END END AS direction_{h}, round(abs(ln(p[{h}].c / en)) / (abs(bf) + abs(gp) + abs(ln(p[{h}].c / en))), 6) AS after_{h}" for h in (2, 4)) + " FROM s WHERE whole")
def direction_targets(spark, d):
    return outcomes.direction_targets(bars.hourly(spark, d), (2, 4))


DIR = "CASE WHEN close > open THEN 1 ELSE -1 END"


def _direction():
    return F.when(F.col("close") > F.col("open"), 1).otherwise(-1)


@query(H + path(4) + f", h AS (SELECT *, unnest([2, 4]) AS horizon, {DIR} AS d FROM x WHERE p[1].i = bar_index + 1) SELECT symbol, session, bar_index, CAST(horizon AS INT) AS horizon, p[1].o AS entry, p[horizon].c AS exit_price, round(10000 * (p[horizon].c / p[1].o - 1), 4) AS raw_bps, round(d * 10000 * (p[horizon].c / p[1].o - 1), 4) AS signed_bps FROM h WHERE p[horizon].i = bar_index + horizon")
def event_horizons(spark, d):
    return outcomes.event_horizons(bars.hourly(spark, d), _direction(), (2, 4))


FW = H + f", e AS (SELECT symbol, session, bar_index, {DIR} AS d, high - low AS rng, close, lead(close, 3) {W}) / close - 1 AS r, max(high) {W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) / close - 1 AS mfe, min(low) {W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) / close - 1 AS mae FROM b), f AS (SELECT *, CASE WHEN d > 0 THEN mfe ELSE -mae END * 10000 AS g, CASE WHEN d > 0 THEN -mae ELSE mfe END * 10000 AS a FROM e WHERE r IS NOT NULL)"


def _forward(spark, d):
    w, f = ordered(SESSION, ["bar_index"]), forward(SESSION, ["bar_index"], 3)
    b = bars.hourly(spark, d).withColumn("d", _direction())
    return b.withColumns({"r": F.lead("close", 3).over(w) / F.col("close") - 1, "mfe": F.max("high").over(f) / F.col("close") - 1, "mae": F.min("low").over(f) / F.col("close") - 1}).where("r is not null")


@query(FW + " SELECT symbol, session, bar_index, CASE WHEN a >= 3000 AND g >= 6000 THEN 'ambiguous_stop_first' WHEN a >= 3000 THEN 'stop' WHEN g >= 6000 THEN 'target' ELSE 'time_exit' END AS exit_reason, round(CASE WHEN a >= 3000 THEN -1.0 WHEN g >= 6000 THEN 2.0 ELSE d * r * 10000 / 3000 END, 5) AS gross_r, round(CASE WHEN a >= 3000 THEN -1.0 WHEN g >= 6000 THEN 2.0 ELSE d * r * 10000 / 3000 END - 10 / 3000.0::DOUBLE, 5) AS net_r FROM f")
def stop_target_exit(spark, d):
    return _forward(spark, d).select(*SESSION, "bar_index", *[c.alias(n) for n, c in outcomes.stop_target(F.col("d"), F.lit(3000.0), 2.0, 10.0, "r", "mfe", "mae").items()])


@query(FW + ", m AS (SELECT *, unnest([{'n': 'fixed', 'k': 3000.0::DOUBLE}, {'n': 'range', 'k': 10000 * rng / close}, {'n': 'none', 'k': 0.0}]) AS q FROM f) SELECT q.n AS model, count(r) AS events, count(*) FILTER (WHERE a >= q.k) AS stops, count(*) FILTER (WHERE g >= q.k * 2) AS targets, round(avg(d * r * 10000 / q.k), 4) AS mean_r, round(avg(CASE WHEN a >= q.k THEN -1.0 ELSE d * r * 10000 / q.k END), 4) AS mean_conservative_r, round(median(g / q.k), 4) AS median_best_r FROM m WHERE q.k > 0 GROUP BY 1")
def stop_models(spark, d):
    risks = {"fixed": F.lit(3000.0), "range": 10000 * (F.col("high") - F.col("low")) / F.col("close"), "none": F.lit(0.0)}
    return outcomes.stop_models(_forward(spark, d), risks, F.col("d"), 2.0, "r", "mfe", "mae")


RP = H + path(6) + f", y AS (SELECT *, {DIR} AS d, list_filter(p, lambda z: z.i = bar_index + 2)[1].o AS en, list_filter(p, lambda z: z.i = bar_index + 6)[1].c AS ex, list_filter(p, lambda z: z.i >= bar_index + 2 AND z.i <= bar_index + 6) AS run FROM x), s AS (SELECT *, CASE WHEN en IS NULL THEN 'missing_exact_entry_bar' WHEN ex IS NULL THEN 'missing_exact_terminal_bar' WHEN len(run) < 5 THEN 'incomplete_constant_terminal_path' ELSE 'available' END AS status FROM y)"


@query(RP + " SELECT symbol, session, bar_index, status, CASE WHEN status = 'available' THEN round(10000 * d * (ex / en - 1), 4) END AS gross, CASE WHEN status = 'available' THEN round(10000 * d * (ex / en - 1) - 10, 4) END AS net, CASE WHEN status = 'available' THEN round(list_max(list_transform(run, lambda z: CASE WHEN d = 1 THEN 10000 * (z.h / en - 1) ELSE 10000 * (1 - z.l / en) END)), 4) END AS mfe FROM s")
def remaining_payoff(spark, d):
    return outcomes.remaining_payoff(bars.hourly(spark, d), _direction(), 6)


@query(H + path(4) + f", y AS (SELECT *, 10000 * ({DIR}) * (p[4].c / p[1].o - 1) AS a, 10000 * ({DIR}) * (p[4].c / p[2].o - 1) AS z FROM x WHERE whole) SELECT symbol, session, bar_index, round(a, 4) AS t0, round(z, 4) AS t1, round(z - a, 4) AS difference FROM y")
def fixed_latency(spark, d):
    return outcomes.fixed_latency(bars.hourly(spark, d), _direction(), 4)


OCO = H + path(5) + ", y AS (SELECT *, high * 1.3 AS u, low * 0.7 AS v FROM x), k AS (SELECT *, list_transform(range(1, len(p) + 1), lambda i: CASE WHEN p[i].i <> bar_index + i THEN 'missing_exact_market_bar' WHEN p[i].o >= u THEN 'gap_up' WHEN p[i].o <= v THEN 'gap_down' WHEN p[i].h >= u AND p[i].l <= v THEN 'ambiguous_dual_oco_cross' WHEN p[i].h >= u THEN 'cross_up' WHEN p[i].l <= v THEN 'cross_down' ELSE 'none' END) AS kd FROM y), s AS (SELECT *, list_min(list_filter(range(1, len(p) + 1), lambda i: kd[i] <> 'none')) AS step FROM k), t AS (SELECT *, coalesce(kd[step], CASE WHEN coalesce(len(p), 0) < 5 THEN 'missing_exact_market_bar' ELSE 'no_trigger' END) AS status FROM s)"


@query(OCO + " SELECT symbol, session, bar_index, status, CASE WHEN ends_with(status, '_up') THEN 1 WHEN ends_with(status, '_down') THEN -1 END AS direction, CAST(step AS INT) AS step, round(CASE status WHEN 'gap_up' THEN greatest(p[step].o, u) WHEN 'gap_down' THEN least(p[step].o, v) WHEN 'cross_up' THEN u WHEN 'cross_down' THEN v END, 6) AS price FROM t")
def oco_trigger(spark, d):
    return outcomes.oco_trigger(bars.hourly(spark, d), F.col("high") * 1.3, F.col("low") * 0.7, 5)


@query("WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS d, o_totalprice AS e, o_totalprice * 1.002 AS x, unnest([0, 5, 10, 15, 20]) AS s FROM orders) SELECT o_orderkey, 'F' || s AS fill_model, round(e * (1 + d * s / 10000.0::DOUBLE), 6) AS price, round(10000 * d * (x / (e * (1 + d * s / 10000.0::DOUBLE)) - 1), 4) AS gross, round(10000 * d * (x / (e * (1 + d * s / 10000.0::DOUBLE)) - 1) - 10, 4) AS net FROM t")
def fill_envelope(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", -1).otherwise(1).alias("d"), F.col("o_totalprice").alias("e"), (F.col("o_totalprice") * 1.002).alias("x"))
    return outcomes.fill_envelope(t, ["o_orderkey"], "d", "e", "x", 10.0)


EO = H + path(4) + ", y AS (SELECT *, p[1].o AS en, p[4].c AS ex, list_max(list_transform(p, lambda z: z.h)) AS hi, list_min(list_transform(p, lambda z: z.l)) AS lo FROM x WHERE whole), k AS (SELECT *, 10000 * (ex / en - 1) AS g, list_transform(p, lambda z: CASE WHEN z.o >= en * 1.4 THEN 'UPPER_FIRST' WHEN z.o <= en * 0.6 THEN 'LOWER_FIRST' WHEN z.h >= en * 1.4 AND z.l <= en * 0.6 THEN 'SAME_BAR_DUAL_TOUCH' WHEN z.h >= en * 1.4 THEN 'UPPER_FIRST' WHEN z.l <= en * 0.6 THEN 'LOWER_FIRST' ELSE '' END) AS kd FROM y), s AS (SELECT *, list_min(list_filter(range(1, 5), lambda i: kd[i] <> '')) AS step FROM k)"


@query(EO + " SELECT symbol, session, bar_index, round(g, 4) AS gross_long, round(g - 2000, 4) AS net_long, round(-g - 2000, 4) AS net_short, round(10000 * (hi / en - 1), 4) AS mfe_long, round(10000 * (lo / en - 1), 4) AS mae_long, CASE WHEN g > 4000 THEN 'LONG' WHEN g < -4000 THEN 'SHORT' ELSE 'NEUTRAL' END AS target, coalesce(kd[step], 'NEITHER') AS first_touch, CAST(step AS INT) AS step FROM s")
def economic_outcome(spark, d):
    return outcomes.economic_outcome(bars.hourly(spark, d), 4, 2000.0)


RO = H + f", r AS (SELECT symbol, session, bar_index, lead(close, 2) {W}) / close - 1 AS v FROM b), q AS (SELECT *, count(*) OVER t AS peers, round(v - avg(v) OVER t, 6) AS residual FROM r WHERE v IS NOT NULL WINDOW t AS (PARTITION BY session, bar_index)), k AS (SELECT *, (rank() OVER (PARTITION BY session, bar_index ORDER BY residual) + (count(*) OVER (PARTITION BY session, bar_index, residual) - 1) / 2 - 1) / nullif(peers - 1, 0) AS pc FROM q)"


@query(RO + " SELECT symbol, session, bar_index, peers, residual, round(pc, 6) AS percentile, CASE WHEN peers < 4 THEN 'UNAVAILABLE' WHEN pc >= 0.8 THEN 'LONG' WHEN pc <= 0.2 THEN 'SHORT' ELSE 'NEUTRAL' END AS target FROM k")
def relative_outcomes(spark, d):
    b = bars.hourly(spark, d)
    v = b.select(*SESSION, "bar_index", (F.lead("close", 2).over(ordered(SESSION, ["bar_index"])) / F.col("close") - 1).alias("v"))
    return outcomes.relative_outcomes(v, ["session", "bar_index"], "v", 4)


SP = H.replace(" FROM events GROUP BY 1, 2, 3)", " FROM events GROUP BY 1, 2, 3), b0 AS (SELECT *, CAST(sign(close - open) AS INT) AS st FROM b)") + path(6, 1, "{'i': bar_index, 's': st}").replace("FROM b)", "FROM b0)") + ", y AS (SELECT *, list_transform(p, lambda z: z.s) AS n, list_concat([st], list_transform(p, lambda z: z.s)) AS a FROM x WHERE whole), k AS (SELECT *, len(list_filter(range(1, 7), lambda i: a[i] <> a[i + 1])) AS tr, list_min(list_filter(range(1, 7), lambda i: n[i] <> st)) AS lv FROM y), q AS (SELECT *, list_min(list_filter(range(1, 7), lambda i: n[i] = st AND i > lv)) AS bk FROM k)"


@query(SP + " SELECT symbol, session, bar_index, CAST(tr AS INT) AS transitions, tr >= 2 AS burst, coalesce(tr >= 2 AND len(list_distinct(a[lv:bk + 1])) <= 3 AND bk IS NOT NULL, false) AS short_closure, CAST(bk AS INT) AS return_step FROM q")
def state_path_closure(spark, d):
    return outcomes.state_path(events.states(bars.hourly(spark, d)), 6)


FE = "WITH e AS (SELECT l_orderkey AS k, datediff('day', o_orderdate, l_shipdate) AS step, l_returnflag || l_linestatus AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey), i AS (SELECT k, step, list_sort(list_distinct(list(kind))) AS ks FROM e WHERE step > 0 AND step <= 40 GROUP BY 1, 2), f AS (SELECT k, min(step) AS step, arg_min(ks, step) AS ks FROM i GROUP BY 1), a AS (SELECT DISTINCT k FROM e)"


@query(FE + " SELECT k, CASE WHEN step IS NULL THEN 'NO_EVENT' WHEN len(ks) > 1 THEN 'DISTINCT_TIE' WHEN ks[1] IN ('AF', 'RF') THEN ks[1] ELSE 'OTHER' END AS primary_class, CAST(step AS INT) AS step FROM a LEFT JOIN f USING (k)")
def first_event_target(spark, d):
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    e = l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("l_orderkey").alias("k"), F.datediff("l_shipdate", "o_orderdate").alias("step"), F.concat("l_returnflag", "l_linestatus").alias("kind"))
    return outcomes.first_event_class(e, ["k"], "step", "kind", ["AF", "RF"], 40)


@query("WITH r AS (SELECT p_partkey, p_size / 500.0::DOUBLE AS a, p_size / 1000.0::DOUBLE AS z, unnest([1, 3, 6]) AS horizon FROM part) SELECT p_partkey, CAST(horizon AS INT) AS horizon, round(pow(1 - a - z, horizon), 6) AS survival, round(a / (a + z) * (1 - pow(1 - a - z, horizon)), 6) AS incidence_a, round(z / (a + z) * (1 - pow(1 - a - z, horizon)), 6) AS incidence_z FROM r")
def competing_risks(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 500).alias("a"), (F.col("p_size") / 1000).alias("z"))
    return outcomes.competing_risks(p, ["p_partkey"], ["a", "z"], (1, 3, 6))


AT = H + ", s AS (SELECT symbol, session, max(high) > 470 AS active FROM b GROUP BY 1, 2), c AS (SELECT session, row_number() OVER (ORDER BY session) AS n FROM (SELECT DISTINCT session FROM b)), o AS (SELECT symbol, n FROM (SELECT symbol, session, active AND NOT coalesce(lag(active) OVER (PARTITION BY symbol ORDER BY session), false) AS e FROM s) JOIN c USING (session) WHERE e), g AS (SELECT symbol, list_sort(list(n)) AS l FROM o GROUP BY 1), f AS (SELECT s.symbol, session, active, n, unnest([2, 5]) AS w, l FROM s JOIN c USING (session) LEFT JOIN g ON g.symbol = s.symbol), h AS (SELECT *, list_filter(coalesce(l, []), lambda x: x > n AND x <= n + w) AS hits, (SELECT max(n) FROM c) AS z FROM f)"


@query(AT + " SELECT symbol, session, CAST(w AS INT) AS \"window\", CASE WHEN n + w > z THEN 'period_boundary' WHEN active THEN 'current_active_not_candidate' WHEN len(hits) > 0 THEN 'activation_observed' ELSE 'no_activation' END AS status, CASE WHEN n + w <= z AND NOT active THEN CAST(hits[1] - n AS INT) END AS sessions_until FROM h")
def activation_targets(spark, d):
    s = bars.hourly(spark, d).groupBy(*SESSION).agg((F.max("high") > 470).alias("active"))
    before = F.coalesce(F.lag("active").over(ordered(["symbol"], ["session"])), F.lit(False))
    onsets = s.withColumn("b", before).where("active and not b")
    return outcomes.activation_targets(s, onsets, s, "symbol", "session", "active", (2, 5))


@query(H + f", f AS (SELECT symbol, session, bar_index FROM b), l AS (SELECT symbol, session, bar_index, round(lead(close) {W}) / close - 1, 6) AS label FROM b) SELECT * FROM f LEFT JOIN l USING (symbol, session, bar_index)")
def hindsight_labels(spark, d):
    b = bars.hourly(spark, d)
    label = b.select(*SESSION, "bar_index", F.round(F.lead("close").over(ordered(SESSION, ["bar_index"])) / F.col("close") - 1, 6).alias("label"), (F.col("bar_index") + 1).alias("available"))
    return outcomes.with_hindsight(b.select(*SESSION, "bar_index", F.col("bar_index").alias("frozen")), label, [*SESSION, "bar_index"], "frozen", "available").drop("frozen", "available")


@query(RUNS + ", e AS (SELECT symbol, session, s, e + 1 AS z, ending FROM r), a AS (SELECT symbol, session, ending, s, z, unnest(range(s, z)) AS bar_index FROM e) SELECT symbol, session, CAST(bar_index AS INT) AS bar_index, CAST(bar_index - s AS INT) AS age, CASE WHEN bar_index + 1 = z THEN ending ELSE 'open' END AS target FROM a SEMI JOIN b ON b.symbol = a.symbol AND b.session = a.session AND b.bar_index = a.bar_index")
def active_event_rows(spark, d):
    b = bars.hourly(spark, d)
    e = events.run_ledger(b).select(*SESSION, F.col("start"), (F.col("end") + 1).alias("z"), "ending")
    return outcomes.active_rows(e, b, "start", "z", "ending").select(*SESSION, "bar_index", "age", "target")
