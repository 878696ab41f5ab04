"""Queries of the summaries. Fills are lineitems: the discount pays, the tax costs, the supplier is the stock."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.windows import forward, ordered, six
from strandline.operators import events, summaries
from strandline.plans.registry import H, W, WD, D, query, table
from strandline.sources import bars

FILLS = "WITH f AS (SELECT *, l_discount * 100 AS gross, l_tax * 100 AS cost, l_discount * 100 - l_tax * 100 AS net, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem)"


def fills(spark, d):
    l = table(spark, d, "lineitem")
    return l.withColumns({"gross": F.col("l_discount") * 100, "cost": F.col("l_tax") * 100, "net": F.col("l_discount") * 100 - F.col("l_tax") * 100, "month": F.date_format("l_shipdate", "yyyy-MM")})


@query(H + " SELECT symbol, count(*) FILTER (WHERE volume IS NULL) AS missing, count(*) FILTER (WHERE volume = 0) AS zero, min(volume) AS low, max(volume) AS high, round(avg(volume), 6) AS mean FROM b GROUP BY 1")
def volume_summary(spark, d):
    return summaries.volume_summary(bars.hourly(spark, d), ["symbol"])


@query("WITH r AS (SELECT l_returnflag, l_shipdate, l_extendedprice AS c, l_extendedprice * (1 - l_discount) AS a FROM lineitem), x AS (SELECT *, abs(a - c) / abs(c) AS q FROM r) SELECT l_returnflag, count(*) FILTER (WHERE a IS NULL) AS missing, count(*) FILTER (WHERE q > 0.000001) AS different, round(max(q), 6) AS largest, min(CASE WHEN q > 0.000001 THEN l_shipdate END) AS first, max(CASE WHEN q > 0.000001 THEN l_shipdate END) AS last FROM x GROUP BY 1")
def adjusted_close_summary(spark, d):
    l = table(spark, d, "lineitem").withColumn("a", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return summaries.adjusted_summary(l, ["l_returnflag"], "l_extendedprice", "a", "l_shipdate")


@query(D + f", r AS (SELECT *, close / lag(close) {WD}) - 1 AS r FROM b), x AS (SELECT *, CASE WHEN r IS NOT NULL THEN close / max(CASE WHEN r IS NOT NULL THEN close END) {WD} ROWS UNBOUNDED PRECEDING) - 1 END AS dd FROM r) SELECT symbol, count(*) AS rows, arg_min(close, session) AS close_start, arg_max(close, session) AS close_end, round(arg_max(close, session) / arg_min(close, session) - 1, 6) AS total_return, round(avg(r), 6) AS mean_return, round(stddev_samp(r), 5) AS volatility, round(avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END), 6) AS hit_rate, round(avg(r) / stddev_samp(r) * sqrt(252), 5) AS sharpe, round(min(dd), 6) AS max_drawdown FROM x GROUP BY 1")
def ohlc_baseline(spark, d):
    return summaries.baseline_summary(bars.daily(spark, d), ["symbol"], ["session"])


@query(H + " SELECT symbol, count(*) AS row_count, arg_min(close, session || printf('%02d', bar_index)) AS first_close, arg_max(close, session || printf('%02d', bar_index)) AS latest_close, min(close) AS min_close, max(close) AS max_close, round(avg(close), 6) AS average_close, sum(volume) AS total_volume FROM b WHERE session BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY 1")
def symbol_bar_summary(spark, d):
    return summaries.bar_summary(bars.hourly(spark, d).where(F.col("session").between("2024-01-05", "2024-01-20")), ["symbol"], F.struct("session", "bar_index"))


@query(H + " SELECT * FROM (SELECT symbol, session, count(*) AS bar_count, arg_min(close, bar_index) AS first_close, arg_max(close, bar_index) AS latest_close, max(high) AS high, min(low) AS low, sum(volume) AS volume FROM b GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY session DESC) <= 20")
def recent_sessions(spark, d):
    return summaries.recent_sessions(bars.hourly(spark, d), 20)


@query("WITH s AS (SELECT o_custkey AS c, count(*) AS rows, min(o_orderdate) AS a, max(o_orderdate) AS z FROM orders GROUP BY 1) SELECT count(*) AS total_symbols, count(rows) AS datasets_present, count(*) FILTER (WHERE rows IS NULL) AS datasets_missing, round(coalesce(avg(rows), 0), 6) AS average_rows, min(a) AS first, max(z) AS last FROM customer LEFT JOIN s ON c = c_custkey")
def universe_health(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("rows"), F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    return summaries.universe_health(table(spark, d, "customer"), o, "c_custkey", "rows", "a", "z")


REASONS = "list_filter([CASE WHEN o_totalprice < 50000 THEN 'too_few_trades' END, CASE WHEN o_orderstatus = 'P' THEN 'walkforward_failure' END, CASE WHEN o_shipped THEN 'unstable_parameters' END], lambda x: x IS NOT NULL)".replace("o_shipped", "o_orderkey // 4 * 4 = o_orderkey")


def _reasons():
    return F.array_compact(F.array(F.when(F.col("o_totalprice") < 50000, "too_few_trades"), F.when(F.col("o_orderstatus") == "P", "walkforward_failure"), F.when(F.floor(F.col("o_orderkey") / 4) * 4 == F.col("o_orderkey"), "unstable_parameters")))


@query(f"SELECT reason, count(*) AS n FROM (SELECT unnest({REASONS}) AS reason FROM orders) GROUP BY 1 ORDER BY n DESC, reason LIMIT 20")
def rejection_reasons(spark, d):
    return summaries.reason_counts(table(spark, d, "orders").select(_reasons().alias("r")), "r")


@query(f"WITH r AS (SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'malformed' ELSE o_orderstatus END AS c, CASE WHEN o_orderpriority LIKE '1%' THEN [] ELSE {REASONS} END AS r, CASE WHEN o_orderpriority NOT LIKE '1%' THEN o_totalprice / 1000 END AS v FROM orders) SELECT c AS classification, count(*) AS n, CAST(sum(len(r)) AS BIGINT) AS reasons, round(avg(v), 6) AS mean_net_return FROM r GROUP BY 1")
def failure_anatomy(spark, d):
    o = table(spark, d, "orders")
    payload = F.to_json(F.struct(F.col("o_orderstatus").alias("classification"), _reasons().alias("classification_reasons"), (F.col("o_totalprice") / 1000).alias("net_return")))
    return summaries.failure_anatomy(o.select(F.when(F.col("o_orderpriority").startswith("1"), "{broken").otherwise(payload).alias("p")), "p")


@query("WITH a AS (SELECT o_custkey AS k, max(o_orderpriority) AS l FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderpriority) AS l FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), s AS (SELECT a.l, 1 AS x, 0 AS y, CASE WHEN b.k IS NULL THEN 1 ELSE 0 END AS g, 0 AS c FROM a LEFT JOIN b USING (k) UNION ALL SELECT b.l, 0, 1, 0, CASE WHEN a.k IS NULL THEN 1 ELSE 0 END FROM b LEFT JOIN a USING (k)) SELECT l AS class, CAST(sum(x) AS BIGINT) AS n_a, CAST(sum(y) AS BIGINT) AS n_b, CAST(sum(y) - sum(x) AS BIGINT) AS delta, CAST(sum(g) AS BIGINT) AS removed, CAST(sum(c) AS BIGINT) AS added FROM s GROUP BY 1")
def compare_runs(spark, d):
    o = table(spark, d, "orders")
    run = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("class"))
    return summaries.compare_runs(run("F"), run("O"), "k", "class")


@query("SELECT coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, 'unknown') AS bucket, count(*) AS trade_count, round(avg(o_totalprice), 6) AS average_net_return FROM orders GROUP BY 1 ORDER BY 2 DESC, 1")
def feature_buckets(spark, d):
    o = table(spark, d, "orders").withColumn("f", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return summaries.feature_buckets(o, "f", "o_totalprice")


@query("""WITH t AS (SELECT o_orderpriority AS symbol, o_orderkey AS k, round((o_totalprice - 250000) / 1000, 6) AS v FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY v DESC, k) AS u, row_number() OVER (PARTITION BY symbol ORDER BY v, k) AS dn, row_number() OVER (PARTITION BY symbol ORDER BY k) - row_number() OVER (PARTITION BY symbol, v < 0 ORDER BY k) AS g FROM t),
 s AS (SELECT symbol, max(n) AS streak FROM (SELECT symbol, g, count(*) AS n FROM r WHERE v < 0 GROUP BY 1, 2) GROUP BY 1) SELECT symbol, count(*) AS trades, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(sum(greatest(v, 0)) / -sum(least(v, 0)), 6) AS profit_factor,
 round(sum(CASE WHEN u <= 5 AND v > 0 THEN v ELSE 0 END) / sum(v), 6) AS top5_share_of_net, round(abs(sum(CASE WHEN dn <= 5 AND v < 0 THEN v ELSE 0 END)) / abs(sum(least(v, 0))), 6) AS top5_losers_share, round(sum(CASE WHEN u <= 5 AND v > 0 THEN v ELSE 0 END) / sum(greatest(v, 0)), 6) AS top5_share_of_profit, round(sum(CASE WHEN u <= 10 AND v > 0 THEN v ELSE 0 END) / sum(greatest(v, 0)), 6) AS top10_share_of_profit, max(streak) AS longest_losing_streak FROM r JOIN s USING (symbol) GROUP BY 1""")
def trade_summary(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderkey").alias("k"), six((F.col("o_totalprice") - 250000) / 1000).alias("v"))
    return summaries.trade_summary(t, ["symbol"], "v", ["k"])


SPLIT = "WITH s AS (SELECT o_orderpriority AS symbol, year(o_orderdate) * 100 + month(o_orderdate) AS split, round(avg(o_totalprice) - 250000, 6) AS r FROM orders GROUP BY 1, 2)"


@query(SPLIT + " SELECT symbol, count(*) AS splits, count(*) FILTER (WHERE r > 0) AS positive, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS profitable_share, CAST(arg_max(split, r) AS INT) AS best_split, round(max(r), 6) AS best, CAST(arg_min(split, r) AS INT) AS worst_split, round(min(r), 6) AS worst, round(greatest(max(r), 0) / sum(greatest(r, 0)), 6) AS top_share FROM s GROUP BY 1")
def split_summary(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("split")).agg(six(F.avg("o_totalprice") - 250000).alias("r"))
    return summaries.split_summary(o, ["symbol"], "split", "r")


@query(FILLS + ", g AS (SELECT l_suppkey, sum(gross) AS g, sum(cost) AS c FROM f GROUP BY 1), m AS (SELECT l_suppkey, m, round(g - c * m, 6) AS n FROM g, (VALUES (0.0), (0.5), (1.0), (1.5), (2.0), (3.0)) t(m)) SELECT l_suppkey, CAST(min(CASE WHEN m > 0 AND n <= 0 THEN m END) AS DOUBLE) AS first_nonpositive, coalesce(bool_or(m = 1.5 AND n > 0), false) AS survives_1_5x FROM m GROUP BY 1")
def cost_stress(spark, d):
    g = fills(spark, d).groupBy("l_suppkey").agg(F.sum("gross").alias("g"), F.sum("cost").alias("c"))
    m = g.withColumn("m", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.5, 1.0, 1.5, 2.0, 3.0)])))
    return summaries.cost_stress(m.withColumn("n", six(F.col("g") - F.col("c") * F.col("m"))), ["l_suppkey"], "m", "n")


ER = H + f""", e AS (SELECT symbol, session, CAST(sign(close - open) AS INT) AS state, {', '.join(f"lead(close, {h}) {W}) / close - 1 AS fwd_{h}, max(high) {W} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) / close - 1 AS mfe_{h}, min(low) {W} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) / close - 1 AS mae_{h}" for h in (1, 3))} FROM b),
 x AS (SELECT symbol, session, state, 1 AS horizon, fwd_1 AS r, mfe_1 AS mfe, mae_1 AS mae FROM e UNION ALL SELECT symbol, session, state, 3, fwd_3, mfe_3, mae_3 FROM e), v AS (SELECT * FROM x WHERE r IS NOT NULL),
 a AS (SELECT state, horizon, max(c) AS sm, count(*) AS symbols FROM (SELECT state, horizon, symbol, count(*) AS c FROM v GROUP BY ALL) GROUP BY 1, 2), s AS (SELECT state, horizon, max(c) AS dm, count(*) AS sessions FROM (SELECT state, horizon, symbol, session, count(*) AS c FROM v GROUP BY ALL) GROUP BY 1, 2),
 g AS (SELECT state, horizon, count(*) AS events, round(median(r), 6) AS median_return, round(avg(r), 6) AS mean_return, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(median(mfe), 6) AS median_mfe, round(median(mae), 6) AS median_mae, round(median(abs(r)), 6) AS median_abs, round(quantile_cont(r, 0.25), 6) AS p25, round(quantile_cont(r, 0.75), 6) AS p75 FROM v GROUP BY 1, 2)"""


@query(ER + " SELECT g.*, symbols, sessions, round(sm / events, 6) AS symbol_share, round(dm / events, 6) AS session_share, round(sm / events, 6) > 0.5 OR round(dm / events, 6) > 0.2 AS concentrated FROM g JOIN a USING (state, horizon) JOIN s USING (state, horizon)")
def event_responses(spark, d):
    b, w = bars.hourly(spark, d), ordered(["symbol", "session"], ["bar_index"])
    cols = {}
    for h in (1, 3):
        f = forward(["symbol", "session"], ["bar_index"], h)
        cols |= {f"fwd_{h}": F.lead("close", h).over(w) / F.col("close") - 1, f"mfe_{h}": F.max("high").over(f) / F.col("close") - 1, f"mae_{h}": F.min("low").over(f) / F.col("close") - 1}
    return summaries.event_responses(b.withColumns(cols).withColumn("state", F.signum(F.col("close") - F.col("open")).cast("int")), "state", (1, 3))


@query(FILLS + " SELECT l_returnflag, count(*) AS n, round(sum(net), 4) AS net FROM f WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1")
def settled_before(spark, d):
    s = summaries.settled_before(fills(spark, d), "l_shipdate", F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")))
    return s.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("net"), 4).alias("net"))


@query(FILLS + """, s AS (SELECT l_returnflag, l_linestatus, l_suppkey, greatest(least(round(avg(net), 9), 2.0), -2.0) AS n, round(avg(cost), 9) AS c, count(*) AS k FROM f GROUP BY 1, 2, 3), q AS (SELECT l_returnflag, l_linestatus, quantile_cont(n, 0.1) AS ln, quantile_cont(n, 0.9) AS hn, quantile_cont(n + c, 0.1) AS lg, quantile_cont(n + c, 0.9) AS hg FROM s GROUP BY 1, 2)
 SELECT l_returnflag, l_linestatus, count(*) AS stocks, CAST(sum(k) AS BIGINT) AS fills, round(avg(greatest(least(n + c, hg), lg)), 6) AS robust_gross, round(sum(c), 6) AS total_cost, round(avg(greatest(least(n, hn), ln)), 6) AS robust_net, round(median(n), 6) AS median_net, array_to_string(list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))), '|') AS ids FROM s JOIN q USING (l_returnflag, l_linestatus) GROUP BY 1, 2""")
def stock_contributions(spark, d):
    return summaries.stock_contributions(fills(spark, d), ["l_returnflag", "l_linestatus"], "l_suppkey", "net", "cost", 2.0)


PANEL = FILLS + ", p AS (SELECT month, l_returnflag AS regime, l_suppkey AS stock, sum(l_quantity) - 30 AS v FROM f GROUP BY 1, 2, 3)"


def _panel(spark, d):
    return fills(spark, d).groupBy("month", F.col("l_returnflag").alias("regime"), F.col("l_suppkey").alias("stock")).agg((F.sum("l_quantity") - 30).alias("v"))


@query(PANEL + ", c AS (SELECT *, median(v) OVER (PARTITION BY month) AS common FROM p), r AS (SELECT *, median(v - common) OVER (PARTITION BY month, regime) AS rp FROM c) SELECT month, regime, stock, round(common, 4) AS common, round(rp, 4) AS regime_part, round(v - common - rp, 4) AS rest FROM r")
def payoff_components(spark, d):
    c = summaries.payoff_components(_panel(spark, d), ["month"], "regime", "v")
    return c.select("month", "regime", "stock", *[F.round(x, 4).alias(x) for x in ("common", "regime_part", "rest")])


@query(PANEL + ", x AS (SELECT *, CASE WHEN regime = 'R' AND stock < 40 THEN '1' WHEN regime = 'R' THEN '2' WHEN stock < 40 THEN '3' ELSE '4' END AS cell FROM p) SELECT cell, count(*) AS rows, count(DISTINCT month) AS sessions, count(DISTINCT stock) AS stocks, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_rate FROM x GROUP BY 1")
def four_way_counterfactual(spark, d):
    return summaries.four_way(_panel(spark, d), F.col("regime") == "R", F.col("stock") < 40, "v", "month", "stock")


@query(FILLS + ", x AS (SELECT l_returnflag, concat(CASE WHEN l_quantity > 25 THEN 'pass' ELSE 'fail' END, '|', CASE WHEN l_linestatus = 'O' THEN 'pass' ELSE 'fail' END) AS cell, gross, net, cost FROM f), g AS (SELECT l_returnflag, cell, count(*) AS n, round(sum(gross), 6) AS gross, round(sum(net), 6) AS net, avg(net) AS mean, round(median(net), 6) AS median, round(sum(cost), 6) AS cost, round(sum(gross - 2 * cost), 6) AS twice_cost_net FROM x GROUP BY 1, 2) SELECT * REPLACE (round(mean, 6) AS mean), round(sum(CASE WHEN cell IN ('pass|pass', 'fail|fail') THEN mean ELSE -mean END) OVER (PARTITION BY l_returnflag), 6) AS contrast FROM g")
def four_cell_interaction(spark, d):
    return summaries.interaction(fills(spark, d), ["l_returnflag"], F.col("l_quantity") > 25, F.col("l_linestatus") == "O", "gross", "net", "cost")


@query(FILLS + " SELECT l_returnflag, count(*) AS opportunities, count(*) FILTER (WHERE l_quantity > 25) AS admitted, count(*) FILTER (WHERE l_quantity <= 25 AND net < 0) AS losers_rejected, count(*) FILTER (WHERE l_quantity <= 25 AND net > 0) AS winners_rejected, round(-coalesce(sum(net) FILTER (WHERE l_quantity <= 25 AND net < 0), 0), 6) AS losses_avoided, round(coalesce(sum(net) FILTER (WHERE l_quantity <= 25 AND net > 0), 0), 6) AS profits_rejected, round(-coalesce(sum(net) FILTER (WHERE l_quantity <= 25 AND net < 0), 0) - coalesce(sum(net) FILTER (WHERE l_quantity <= 25 AND net > 0), 0), 6) AS veto_value, round(sum(net) FILTER (WHERE l_quantity > 25), 6) AS retained, round(avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM f GROUP BY 1")
def veto_accounting(spark, d):
    return summaries.veto_accounting(fills(spark, d), ["l_returnflag"], F.col("l_quantity") > 25, "net")


PAIRS = "WITH v AS (SELECT o_orderkey AS id, o_orderstatus, o_orderpriority, round(o_totalprice * 0.01, 6) AS t, round(o_totalprice * 0.012 - 600, 6) AS c FROM orders)"


def _paired(spark, d):
    o = table(spark, d, "orders")
    both = F.array(F.struct(F.lit("t").alias("variant"), six(F.col("o_totalprice") * 0.01).alias("v")), F.struct(F.lit("c").alias("variant"), six(F.col("o_totalprice") * 0.012 - 600).alias("v")))
    rows = o.select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority", F.explode(both).alias("x")).select("id", "o_orderstatus", "o_orderpriority", "x.*")
    return summaries.paired_differences(rows, ["id", "o_orderstatus", "o_orderpriority"], "variant", "v", "t", "c")


@query(PAIRS + " SELECT id, t AS treatment, c AS control, round(t - c, 6) AS difference FROM v")
def paired_differences(spark, d):
    return _paired(spark, d).select("id", "treatment", "control", six(F.col("difference")).alias("difference"))


@query(PAIRS + ", s AS (SELECT *, unnest([{'a': 'all', 'b': 'all'}, {'a': 'o_orderstatus', 'b': o_orderstatus}, {'a': 'o_orderpriority', 'b': o_orderpriority}]) AS z FROM v) SELECT z.a AS slice, z.b AS value, count(*) AS n, round(avg(t), 6) AS treatment, round(avg(c), 6) AS control, round(median(t - c), 6) AS median_difference, round(avg(CASE WHEN t > c THEN 1.0 ELSE 0.0 END), 6) AS improved FROM s GROUP BY 1, 2")
def paired_breakdowns(spark, d):
    m = {"n": F.count(F.lit(1)), "treatment": six(F.avg("treatment")), "control": six(F.avg("control")), "median_difference": six(F.percentile("difference", F.lit(0.5))), "improved": six(F.avg((F.col("treatment") > F.col("control")).cast("double")))}
    return summaries.slices(_paired(spark, d), ["o_orderstatus", "o_orderpriority"], m)


@query(FILLS + ", g AS (SELECT l_suppkey, sum(net) AS s, count(net) AS n FROM f GROUP BY 1), t AS (SELECT l_suppkey FROM g ORDER BY round(s, 6) DESC, l_suppkey LIMIT 5) SELECT CAST(sum(n) AS BIGINT) AS remaining, round(sum(s), 4) AS total, round(sum(s) / sum(n), 6) AS mean FROM g ANTI JOIN t USING (l_suppkey)")
def remove_top_contributors(spark, d):
    return summaries.without_top(fills(spark, d), "l_suppkey", "net", 5)


@query(FILLS + ", g AS (SELECT l_returnflag, year(l_shipdate) || 'Q' || quarter(l_shipdate) AS quarter, sum(net) AS s, count(net) AS n FROM f GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag) - n AS rn, sum(s) OVER (PARTITION BY l_returnflag) - s AS rs FROM g) SELECT l_returnflag, quarter, CAST(rn AS BIGINT) AS rows, round(rs / nullif(rn, 0), 6) AS mean, rs / nullif(rn, 0) > 0 AS positive FROM t")
def quarter_deletion(spark, d):
    f = fills(spark, d).withColumn("quarter", F.concat(F.year("l_shipdate"), F.lit("Q"), F.quarter("l_shipdate")))
    return summaries.deletion_metrics(f, ["l_returnflag"], "quarter", "net")


TAIL = "WITH f AS (SELECT l_returnflag AS model, l_suppkey AS stock, strftime(l_shipdate, '%Y-%m') AS session, CAST(l_linenumber AS DOUBLE) AS w, l_extendedprice / 1000 AS mv, l_quantity * 1.5 AS ex, l_extendedprice / 1000 - l_quantity * 1.5 AS res, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS k FROM lineitem WHERE l_discount >= 0.09)"
Q3 = ", e AS (SELECT model, res AS v, sum(w) AS w FROM f GROUP BY 1, 2), p AS (SELECT *, (sum(w) OVER o - w / 2) / sum(w) OVER (PARTITION BY model) AS p FROM e WINDOW o AS (PARTITION BY model ORDER BY v)), i AS (SELECT *, lag(v) OVER o AS pv, lag(p) OVER o AS pp FROM p WINDOW o AS (PARTITION BY model ORDER BY v))"


def _at(q: float, name: str) -> str:
    return f"round(max(CASE WHEN pp < {q} AND p >= {q} THEN pv + (v - pv) * ({q} - pp) / (p - pp) WHEN pp IS NULL AND p >= {q} THEN v END), 6) AS {name}"


def _tail(spark, d):
    l = table(spark, d, "lineitem").where("l_discount >= 0.09")
    return l.select(F.col("l_returnflag").alias("model"), F.col("l_suppkey").alias("stock"), F.date_format("l_shipdate", "yyyy-MM").alias("session"), F.col("l_linenumber").cast("double").alias("w"), (F.col("l_extendedprice") / 1000).alias("mv"), (F.col("l_quantity") * 1.5).alias("ex"), (F.col("l_extendedprice") / 1000 - F.col("l_quantity") * 1.5).alias("res"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("k"))


@query(TAIL + Q3 + f""", q AS (SELECT model, {_at(0.05, 'p05')}, {_at(0.5, 'p50')}, {_at(0.95, 'p95')} FROM i GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY res, k) AS n, count(*) OVER (PARTITION BY model) AS t FROM f),
 g AS (SELECT model, count(*) AS rows, count(DISTINCT session) AS sessions, count(DISTINCT stock) AS stocks, round(sum(mv * w) / sum(w), 6) AS mean_movement, round(sum(ex * w) / sum(w), 6) AS mean_expected, round(sum(res * w) / sum(w), 6) AS mean_residual, round(sum(CASE WHEN n > floor(t * 0.1) AND n <= t - floor(t * 0.1) THEN w * res END) / sum(CASE WHEN n > floor(t * 0.1) AND n <= t - floor(t * 0.1) THEN w END), 6) AS trimmed_residual, round(sum(CASE WHEN res > 0 THEN w ELSE 0 END) / sum(w), 6) AS positive_rate, round(sum(CASE WHEN n > t - greatest(1, ceil(t * 0.05)) THEN w * greatest(res, 0) END) / sum(w * greatest(res, 0)), 6) AS top_share FROM r GROUP BY 1),
 a AS (SELECT model, round(max(c) / sum(c), 6) AS most_stock FROM (SELECT model, stock, count(*) AS c FROM f GROUP BY 1, 2) GROUP BY 1), z AS (SELECT model, round(max(c) / sum(c), 6) AS most_session FROM (SELECT model, session, count(*) AS c FROM f GROUP BY 1, 2) GROUP BY 1) SELECT * FROM g JOIN q USING (model) JOIN a USING (model) JOIN z USING (model)""")
def tail_metrics(spark, d):
    return summaries.tail_metrics(_tail(spark, d), ["model"], "w", "mv", "res", "ex", "session", "stock", "k")


@query(TAIL + Q3 + f", q AS (SELECT model, {_at(0.5, 'median_residual')}, {_at(0.9, 'upper_decile')} FROM i GROUP BY 1), g AS (SELECT model, count(*) AS rows, round(sum(mv * w) / sum(w), 6) AS mean_movement, round(sum(CASE WHEN mv > ex THEN w ELSE 0 END) / sum(w), 6) AS exceed_rate, round(sum(w * mv) / sum(w * ex), 6) AS ratio FROM f GROUP BY 1) SELECT * FROM g JOIN q USING (model)")
def route_state_metrics(spark, d):
    t = _tail(spark, d)
    w = F.col("w")
    g = t.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), six(summaries.weighted_mean(F.col("mv"), w)).alias("mean_movement"), six(summaries.weighted_mean((F.col("mv") > F.col("ex")).cast("double"), w)).alias("exceed_rate"), six(F.sum(w * F.col("mv")) / F.sum(w * F.col("ex"))).alias("ratio"))
    return g.join(summaries.weighted_quantiles(t, ["model"], "res", "w", {"median_residual": 0.5, "upper_decile": 0.9}), "model")


@query("SELECT o_orderpriority, round(sum(o_totalprice * month(o_orderdate)) / sum(month(o_orderdate)), 4) AS mean FROM orders GROUP BY 1")
def weighted_mean(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(summaries.weighted_mean(F.col("o_totalprice"), F.month("o_orderdate").cast("double")), 4).alias("mean"))


PB = H + ", s AS (SELECT symbol, session, bool_or(close > 480) AS hit FROM b GROUP BY 1, 2), r AS (SELECT symbol, (count(*) FILTER (WHERE hit) + 1.0::DOUBLE) / (count(*) + 2) AS p FROM s GROUP BY 1), j AS (SELECT session, p FROM s JOIN r USING (symbol))"


@query(PB + ", g AS (SELECT session, product(1 - p) AS p0, product(1 - p) * sum(p / (1 - p)) AS p1 FROM j GROUP BY 1) SELECT session, round(p0, 6) AS none, round(p1, 6) AS one, round(1 - p0 - p1, 6) AS two_or_more FROM g")
def poisson_binomial(spark, d):
    s = bars.hourly(spark, d).groupBy("symbol", "session").agg(F.bool_or(F.col("close") > 480).alias("hit"))
    r = s.groupBy("symbol").agg(((F.count_if(F.col("hit")) + 1) / (F.count(F.lit(1)) + 2)).alias("p"))
    x = summaries.poisson_binomial(s.join(F.broadcast(r), "symbol"), ["session"], "symbol", "p")
    none, one = F.get("distribution", F.lit(0)), F.coalesce(F.get("distribution", F.lit(1)), F.lit(0.0))
    rest = F.aggregate(F.slice("distribution", F.lit(3), F.lit(100)), F.lit(0.0), lambda a, v: a + v)
    return x.select("session", six(none).alias("none"), six(one).alias("one"), six(rest).alias("two_or_more"))


@query("WITH q AS (SELECT l_returnflag, l_linenumber AS n, count(*) AS c FROM lineitem GROUP BY 1, 2), p AS (SELECT l_returnflag, n, c / sum(c) OVER (PARTITION BY l_returnflag) AS p FROM q), k AS (SELECT a.n + b.n AS steps, sum(a.p * b.p) AS p FROM p a, p b WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'R' GROUP BY 1) SELECT CAST(steps AS INT) AS steps, round(p, 6) AS p FROM k WHERE steps <= 8 UNION ALL SELECT 1, 0.0")
def convolve_durations(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("c"))
    pmf = c.groupBy("l_returnflag").agg(F.transform(F.sequence(F.lit(1), F.max("l_linenumber")), lambda k: F.coalesce(F.try_element_at(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "c"))), k), F.lit(0)) / F.sum("c")).alias("p"))
    both = pmf.agg(F.max(F.when(F.col("l_returnflag") == "A", F.col("p"))).alias("a"), F.max(F.when(F.col("l_returnflag") == "R", F.col("p"))).alias("r"))
    return both.select(F.posexplode(summaries.durations_within(F.col("a"), F.col("r"), 8)).alias("i", "p")).select((F.col("i") + 1).alias("steps"), six(F.col("p")).alias("p"))


@query("WITH e AS (SELECT s_nationkey AS g, strftime(l_shipdate, '%Y-%m') AS m, l_suppkey AS s FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_discount > 0.095), n AS (SELECT g, count(*) AS n FROM e GROUP BY 1), m AS (SELECT g, max(c) AS m FROM (SELECT g, m, count(*) AS c FROM e GROUP BY 1, 2) GROUP BY 1), s AS (SELECT g, max(c) AS s FROM (SELECT g, s, count(*) AS c FROM e GROUP BY 1, 2) GROUP BY 1), x AS (SELECT *, CAST(greatest(0, m - floor(0.1 * n + 1e-12)) AS BIGINT) AS me, CAST(greatest(0, s - floor(0.4 * n + 1e-12)) AS BIGINT) AS se FROM n JOIN m USING (g) JOIN s USING (g)) SELECT g AS s_nationkey, n AS events, round(m / n, 6) AS month_share, round(s / n, 6) AS stock_share, round(ceil(n / 80.0) / n, 6) AS least_month_share, round(ceil(n / 20.0) / n, 6) AS least_stock_share, me AS month_excess, se AS stock_excess, 1.0 / n > 0.05 OR (greatest(me, se) > 0 AND greatest(me, se) <= 2) AS fragile FROM x")
def small_count_feasibility(spark, d):
    l, s = table(spark, d, "lineitem").where("l_discount > 0.095"), table(spark, d, "supplier")
    e = l.join(s, l.l_suppkey == s.s_suppkey).select("s_nationkey", F.date_format("l_shipdate", "yyyy-MM").alias("m"), "l_suppkey")
    return summaries.small_counts(e, ["s_nationkey"], "m", "l_suppkey", 0.1, 0.4, 80, 20)


@query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 400000), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS intersection, count(*) AS \"union\", round(count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) / count(*), 6) AS jaccard, count(*) FILTER (WHERE b.k IS NULL) AS only_a, count(*) FILTER (WHERE a.k IS NULL) AS only_b FROM a FULL JOIN b ON a.k = b.k")
def tail_overlap(spark, d):
    o = table(spark, d, "orders")
    return summaries.overlap(o.where("o_totalprice > 400000"), o.where("o_orderstatus = 'P'"), "o_custkey")
