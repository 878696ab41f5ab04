"""The registered queries, each with SQL that DuckDB runs on the same tables; further families are in ``strandline.plans``."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.windows import six
from strandline.operators import backtest, events, features, joins, metrics, options, text, validation
from strandline.plans.registry import H, ORACLE_SQL, QUERIES, RUNS, WD, D, W, query
from strandline.plans.registry import table as _t
from strandline.sources import bars, market_data
from strandline.streaming import stream_bars as streams

# bars and stores


@query(H + " SELECT * FROM b")
def bars_hourly(spark, d):
    return bars.hourly(spark, d)


@query(D + " SELECT * FROM b")
def bars_daily(spark, d):
    return bars.daily(spark, d)


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def dedup_keep_last(spark, d):
    return market_data.keep_last(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders")
def upsert(spark, d):
    o = _t(spark, d, "orders")
    old, new = o.select("o_orderkey", F.col("o_totalprice").alias("price")), o.where("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_totalprice") + 1).alias("price"))
    return market_data.upsert(old, new, ["o_orderkey"])


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def guarded_sql(spark, d):
    return market_data.query_dataset(spark, f"{d}/events.parquet", "select event_type, count(*) as n, round(avg(value), 6) as mean from dataset group by event_type")


@query("SELECT event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'")
def window_scan(spark, d):
    return market_data.read_window(spark, f"{d}/events.parquet", ["event_id", "value"], "ts", F.to_timestamp_ntz(F.lit("2024-01-05 00:00:00")), F.to_timestamp_ntz(F.lit("2024-01-06 00:00:00")), 100_000_000)


@query("SELECT event_id, value FROM events ORDER BY ts DESC LIMIT 50")
def tail_scan(spark, d):
    return market_data.read_tail(spark, f"{d}/events.parquet", ["event_id", "value", "ts"], "ts", 50).select("event_id", "value")


# validation


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def validate_duplicates(spark, d):
    return validation.duplicates(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(H + " SELECT symbol, CAST(count(*) FILTER (WHERE high < greatest(open, close)) AS BIGINT) AS high_below, CAST(count(*) FILTER (WHERE low > least(open, close)) AS BIGINT) AS low_above, CAST(count(*) FILTER (WHERE low <= 0) AS BIGINT) AS non_positive FROM b GROUP BY 1")
def validate_ohlc(spark, d):
    return validation.ohlc(bars.hourly(spark, d))


@query(H + " SELECT g.symbol, g.session, g.i AS bar_index FROM (SELECT symbol, session, unnest(range(0, 24))::INT AS i FROM (SELECT DISTINCT symbol, session FROM b)) g ANTI JOIN b ON g.symbol = b.symbol AND g.session = b.session AND g.i = b.bar_index")
def validate_gaps(spark, d):
    return validation.missing_bars(bars.hourly(spark, d))


@query(H + f", x AS (SELECT *, volume <= 1 AS z, row_number() {W}) AS n FROM b), y AS (SELECT *, n - row_number() OVER (PARTITION BY symbol, session, z ORDER BY bar_index) AS g FROM x) SELECT symbol, session, min(bar_index) AS start, count(*) AS length FROM y WHERE z GROUP BY symbol, session, g HAVING count(*) >= 3")
def quiet_runs(spark, d):
    return validation.quiet_runs(bars.hourly(spark, d), F.col("volume") <= 1)


@query(D + f" SELECT * FROM (SELECT symbol, session, round(close / lag(close) {WD}) - 1, 6) AS jump FROM b) WHERE abs(jump) > 0.2")
def large_jumps(spark, d):
    return validation.large_jumps(bars.daily(spark, d))


@query(D + f", r AS (SELECT *, close * volume AS dv, row_number() OVER (PARTITION BY symbol ORDER BY session DESC) AS k FROM b) SELECT symbol, count(*) AS rows, arg_max(close, session) AS last_close, round(median(dv) FILTER (WHERE k <= 60), 6) AS median_dollar_volume, min(session) AS first, max(session) AS last FROM r GROUP BY 1")
def dataset_stats(spark, d):
    return validation.dataset_stats(bars.daily(spark, d))


@query(D + f", r AS (SELECT *, close * volume AS dv, row_number() OVER (PARTITION BY symbol ORDER BY session DESC) AS k FROM b), s AS (SELECT symbol, count(*) AS n, arg_max(close, session) AS c, median(dv) FILTER (WHERE k <= 60) AS m FROM r GROUP BY 1) SELECT symbol, concat_ws(',', CASE WHEN n < 1500 THEN 'history' END, CASE WHEN c < 5 THEN 'price' END, CASE WHEN m < 150000 THEN 'liquidity' END) AS reasons FROM s")
def qualify_universe(spark, d):
    return validation.qualify(validation.dataset_stats(bars.daily(spark, d)), 1500, 5.0, 150000.0)


@query(D + f", r AS (SELECT symbol, close / lag(close) {WD}) - 1 AS x FROM b) SELECT symbol, count(x) AS n, round(avg(x), 6) AS mean, round(min(x), 6) AS low, round(max(x), 6) AS high, round(stddev_samp(x), 5) AS sd FROM r GROUP BY 1")
def return_summary(spark, d):
    return validation.return_summary(bars.daily(spark, d))


@query(D + f", r AS (SELECT symbol, session, abs(close / lag(close) {WD}) - 1) AS x FROM b) SELECT symbol, session, round(x, 6) AS move FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY x DESC, session) AS k FROM r WHERE x IS NOT NULL) WHERE k <= 5")
def largest_moves(spark, d):
    return validation.largest_moves(bars.daily(spark, d))


# session features


@query(H + f" SELECT symbol, session, bar_index, row_number() {W}) - 1 AS place, count(*) OVER (PARTITION BY symbol, session) - row_number() {W}) AS remaining, row_number() {W}) = 1 AS is_first, row_number() {W}) = count(*) OVER (PARTITION BY symbol, session) AS is_last, 24 - count(*) OVER (PARTITION BY symbol, session) AS missing, bar_index * 60 AS minutes_from_open FROM b")
def session_clock(spark, d):
    return features.session_clock(bars.hourly(spark, d))


@query(H + f", v AS (SELECT *, sum((high + low + close) / 3 * volume) {W} ROWS UNBOUNDED PRECEDING) / sum(volume) {W} ROWS UNBOUNDED PRECEDING) AS v FROM b) SELECT symbol, session, bar_index, round(v, 6) AS vwap, round(close / v - 1, 6) AS distance, close > v AS above FROM v")
def session_features(spark, d):
    return features.session_vwap(bars.hourly(spark, d))


@query(H + ", e AS (SELECT symbol, session, max(high) AS h, min(low) AS l, count(*) AS n FROM b WHERE bar_index < 3 GROUP BY 1, 2) SELECT b.symbol, b.session, bar_index, CASE WHEN bar_index >= 3 AND n >= 3 THEN h END AS or_high, CASE WHEN bar_index >= 3 AND n >= 3 THEN l END AS or_low, round(CASE WHEN bar_index >= 3 AND n >= 3 THEN (h + l) / 2 END, 6) AS or_mid, round(CASE WHEN bar_index >= 3 AND n >= 3 THEN h - l END, 6) AS or_width FROM b LEFT JOIN e USING (symbol, session)")
def opening_range(spark, d):
    return features.opening_range(bars.hourly(spark, d))


@query(H + ", v AS (SELECT *, avg(volume) OVER w AS m, count(volume) OVER w AS n FROM b WINDOW w AS (PARTITION BY symbol, bar_index ORDER BY session ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) SELECT symbol, session, bar_index, round(CASE WHEN n >= 5 AND m > 0 THEN volume / m END, 6) AS relative_volume FROM v")
def relative_volume(spark, d):
    return features.relative_volume(bars.hourly(spark, d))


@query(H + f", s AS (SELECT symbol, session, max(high) AS h, min(low) AS l, arg_max(close, bar_index) AS c, arg_min(open, bar_index) AS o FROM b GROUP BY 1, 2), p AS (SELECT *, lag(h) {WD}) AS ph, lag(l) {WD}) AS pl, lag(c) {WD}) AS pc FROM s) SELECT symbol, session, ph AS prev_high, pl AS prev_low, pc AS prev_close, round(o / pc - 1, 6) AS gap, o > ph OR o < pl AS outside FROM p")
def previous_session_levels(spark, d):
    return features.previous_session_levels(bars.hourly(spark, d))


@query(H + f", r AS (SELECT *, max(high) {W} ROWS 2 PRECEDING) - min(low) {W} ROWS 2 PRECEDING) AS r FROM b), z AS (SELECT *, avg(r) {W} ROWS 5 PRECEDING) AS m, stddev_samp(r) {W} ROWS 5 PRECEDING) AS sd FROM r) SELECT symbol, session, bar_index, round(r, 6) AS recent_range, round(CASE WHEN sd > 0 THEN (r - m) / sd END, 4) AS compression_z FROM z")
def range_compression(spark, d):
    return features.range_compression(bars.hourly(spark, d))


@query(H + f", n AS (SELECT *, row_number() {W}) AS n, close > open AS e FROM b), x AS (SELECT *, n - max(CASE WHEN e THEN n END) {W} ROWS UNBOUNDED PRECEDING) AS h FROM n) SELECT symbol, session, bar_index, h AS bars_held, coalesce(h >= 4, false) AS time_stop FROM x")
def bars_since_entry(spark, d):
    return features.bars_since(bars.hourly(spark, d), F.col("close") > F.col("open"))


@query(H + f", g AS (SELECT *, bar_index - row_number() {W}) AS g FROM b) SELECT symbol, session, CAST(row_number() OVER (PARTITION BY symbol, session ORDER BY g) - 1 AS BIGINT) AS segment, min(bar_index) AS start, max(bar_index) AS \"end\", count(*) AS bars FROM g GROUP BY symbol, session, g")
def segments_gap(spark, d):
    return features.segments(bars.hourly(spark, d))


@query(H + f""", r AS (SELECT symbol, session, bar_index, close / lag(close) {W}) - 1 AS ret FROM b), x AS (SELECT *, count(*) OVER p AS n, avg(ret) OVER p AS m, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) OVER p AS br, stddev_samp(ret) OVER p AS sd FROM r WHERE ret IS NOT NULL WINDOW p AS (PARTITION BY session, bar_index))
 SELECT symbol, session, bar_index, n AS peers, round(CASE WHEN n >= 3 THEN ((SELECT count(*) FROM x y WHERE y.session = x.session AND y.bar_index = x.bar_index AND y.ret < x.ret) + (SELECT count(*) - 1 FROM x y WHERE y.session = x.session AND y.bar_index = x.bar_index AND y.ret = x.ret) / 2) / (n - 1) END, 6) AS rank_score,
 round(ret - m, 6) AS relative, round(br, 6) AS breadth, round(sd, 5) AS dispersion, round((SELECT median(y.ret) FROM x y WHERE y.session = x.session AND y.bar_index = x.bar_index AND y.symbol <> x.symbol), 6) AS rest_median FROM x""")
def cross_section(spark, d):
    return features.cross_section(bars.hourly(spark, d))


REGIMES = D + f""", r AS (SELECT *, close / lag(close) {WD}) - 1 AS ret, row_number() {WD}) AS n FROM b),
 v AS (SELECT *, CASE WHEN count(ret) {WD} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) >= 10 THEN round(stddev_samp(ret) {WD} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 9) END AS vol,
 round(CASE WHEN n > 10 THEN avg(close) {WD} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END - CASE WHEN n > 20 THEN avg(close) {WD} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END, 9) AS tr,
 lag(close) {WD}) / max(close) {WD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 <= -0.1 AS dd FROM r),
 m AS (SELECT *, CASE WHEN count(vol) {WD} ROWS UNBOUNDED PRECEDING) >= 10 THEN quantile_cont(vol, 0.5) {WD} ROWS UNBOUNDED PRECEDING) END AS med FROM v),
 g AS (SELECT symbol, session, ret, CASE WHEN vol IS NULL OR med IS NULL THEN 'unknown' WHEN vol > med THEN 'high' ELSE 'low' END AS volatility, CASE WHEN tr IS NULL THEN 'unknown' WHEN tr > 0 THEN 'up' ELSE 'down' END AS trend, coalesce(dd, false) AS drawdown FROM m)"""


@query(REGIMES + " SELECT symbol, session, round(ret, 6) AS ret, volatility, trend, drawdown FROM g")
def regime_labels(spark, d):
    return features.regimes(bars.daily(spark, d)).withColumn("ret", six(F.col("ret")))


@query(REGIMES + " SELECT volatility, count(*) AS rows, round(avg(ret), 6) AS mean_ret, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM g WHERE ret IS NOT NULL GROUP BY 1")
def regime_performance(spark, d):
    return features.regime_performance(bars.daily(spark, d))


@query(D + f", s AS (SELECT *, list(close) {WD} ROWS 59 PRECEDING) AS l FROM b) SELECT symbol, session, round(CASE WHEN len(l) >= 5 THEN ((len(list_filter(l, lambda x: x < close)) + 0.5 * len(list_filter(l, lambda x: x = close))) / len(l) - 0.5) * 2 END, 6) AS rank_score FROM s")
def causal_rank(spark, d):
    return features.causal_rank(bars.daily(spark, d))


@query("WITH RECURSIVE " + D.removeprefix("WITH ") + ", n AS (SELECT symbol, session, close, row_number() OVER (PARTITION BY symbol ORDER BY session) AS n FROM b), e AS (SELECT symbol, session, n, close AS v FROM n WHERE n = 1 UNION ALL SELECT n.symbol, n.session, n.n, e.v * (1 - 2.0 / 21) + n.close * (2.0 / 21) FROM e JOIN n ON n.symbol = e.symbol AND n.n = e.n + 1) SELECT symbol, session, round(CASE WHEN n >= 15 THEN v END, 2) AS ewm FROM e")
def ewm_extension(spark, d):
    return features.ewm(bars.daily(spark, d))


@query(D + f", r AS (SELECT *, close / lag(close) {WD}) - 1 AS ret FROM b), s AS (SELECT *, CASE WHEN sign(ret) = lag(sign(ret)) {WD}) THEN 1.0 WHEN sign(ret) IS NULL OR lag(sign(ret)) {WD}) IS NULL THEN NULL ELSE 0.0 END AS same FROM r) SELECT symbol, session, round(CASE WHEN count(ret) OVER w >= 20 THEN stddev_samp(ret) OVER w * sqrt(252) END, 5) AS vol20, round((high - low) / close, 6) AS range_ratio, round(CASE WHEN count(ret) OVER w >= 20 THEN abs(sum(ret) OVER w) / sum(abs(ret)) OVER w END, 5) AS efficiency, round(CASE WHEN count(same) OVER w >= 19 THEN avg(same) OVER w END, 6) AS persistence FROM s WINDOW w AS (PARTITION BY symbol ORDER BY session ROWS 19 PRECEDING)")
def daily_features(spark, d):
    return features.daily_features(bars.daily(spark, d))


# labels, events, paths


@query(H + f" SELECT symbol, session, bar_index, round(lead(close, 1) {W}) / close - 1, 6) AS fwd_1, round(lead(close, 3) {W}) / close - 1, 6) AS fwd_3 FROM b")
def forward_returns(spark, d):
    return events.forward_returns(bars.hourly(spark, d))


@query(H + f" SELECT symbol, session, bar_index, round(max(high) {W} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) / close - 1, 6) AS mfe, round(min(low) {W} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) / close - 1, 6) AS mae FROM b")
def mfe_mae(spark, d):
    return events.excursions(bars.hourly(spark, d))


@query(H + f", n AS (SELECT *, row_number() {W}) AS n FROM b), j AS (SELECT a.symbol, a.session, a.bar_index, min(CASE WHEN c.high >= a.close * 1.2 THEN c.n - a.n END) AS t, min(CASE WHEN c.low <= a.close * 0.8 THEN c.n - a.n END) AS s FROM n a LEFT JOIN n c ON a.symbol = c.symbol AND a.session = c.session AND c.n BETWEEN a.n + 1 AND a.n + 6 GROUP BY ALL) SELECT symbol, session, bar_index, CASE WHEN s IS NOT NULL AND (t IS NULL OR s <= t) THEN 'stop' WHEN t IS NOT NULL THEN 'target' ELSE 'none' END AS outcome, CAST(coalesce(least(t, s), 0) AS INT) AS bars FROM j")
def first_barrier(spark, d):
    return events.first_barrier(bars.hourly(spark, d))


EDGES = H + f", e AS (SELECT symbol, session, bar_index, close FROM (SELECT *, coalesce(lag(close > open) {W}), false) AS l FROM b) WHERE close > open AND NOT l)"


@query(EDGES + " SELECT symbol, session, bar_index, close FROM e")
def edge_events(spark, d):
    return events.edge_events(bars.hourly(spark, d), F.col("close") > F.col("open")).select("symbol", "session", "bar_index", "close")


@query("WITH RECURSIVE " + EDGES.removeprefix("WITH ") + ", g AS (SELECT symbol, session, min(bar_index) AS bar_index FROM e GROUP BY 1, 2 UNION ALL SELECT g.symbol, g.session, (SELECT min(e.bar_index) FROM e WHERE e.symbol = g.symbol AND e.session = g.session AND e.bar_index > g.bar_index + 4) AS bar_index FROM g WHERE g.bar_index IS NOT NULL) SELECT symbol, session, bar_index FROM g WHERE bar_index IS NOT NULL")
def greedy_embargo(spark, d):
    return events.embargoed(events.edge_events(bars.hourly(spark, d), F.col("close") > F.col("open")), 4)


@query("WITH i AS (SELECT user_id, epoch_us(ts) // 60000000 AS s, epoch_us(ts) // 60000000 + 30 AS e FROM events), f AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM i), g AS (SELECT *, sum(CASE WHEN far IS NULL OR s > far THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT user_id, CAST(min(s) AS BIGINT) AS s, CAST(max(e) AS BIGINT) AS e, count(*) AS n FROM g GROUP BY user_id, k")
def interval_merge(spark, d):
    m = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60)
    return events.merged_intervals(_t(spark, d, "events").select("user_id", m.alias("s"), (m + 30).alias("e")), ["user_id"], "s", "e")


@query(RUNS + " SELECT symbol, session, CAST(run AS BIGINT) AS run, state, s AS start, e AS \"end\", duration, ending FROM r")
def run_ledger(spark, d):
    return events.run_ledger(bars.hourly(spark, d))


@query(RUNS + ", m AS (SELECT symbol, session, run, concat_ws('>', lag(state, 2) OVER p, lag(state) OVER p, state) AS motif, lag(state, 2) OVER p AS p2 FROM r WINDOW p AS (PARTITION BY symbol, session ORDER BY run)) SELECT symbol, session, CAST(run AS BIGINT) AS run, motif, row_number() OVER (PARTITION BY symbol, session, motif ORDER BY run) - 1 AS seen_before FROM m WHERE p2 IS NOT NULL")
def state_motifs(spark, d):
    return events.state_motifs(bars.hourly(spark, d))


@query(RUNS + ", p AS (SELECT lag(state) OVER (PARTITION BY symbol, session ORDER BY run) AS a, state AS b FROM r), c AS (SELECT a, b, count(*) AS n FROM p WHERE a <> b GROUP BY 1, 2), g AS (SELECT x.v AS source, y.v AS target FROM (VALUES (-1), (0), (1)) x(v), (VALUES (-1), (0), (1)) y(v)), z AS (SELECT source, target, CASE WHEN source = target THEN 0.0 ELSE coalesce(n, 0) + 0.5 END AS x FROM g LEFT JOIN c ON a = source AND b = target) SELECT source, target, round(CAST(x AS DOUBLE) / sum(CAST(x AS DOUBLE)) OVER (PARTITION BY source), 6) AS p FROM z")
def transition_matrix(spark, d):
    return events.transition_matrix(bars.hourly(spark, d))


@query(H + " SELECT CAST(sign(close - open) AS INT) AS state, count(*) AS n, round(count(*) / (SELECT count(*) FROM b), 6) AS share FROM b GROUP BY 1")
def state_occupancy(spark, d):
    return events.occupancy(bars.hourly(spark, d))


@query(RUNS + ", p AS (SELECT symbol, state, lag(state) OVER w AS p1, lag(state, 2) OVER w AS p2 FROM r WINDOW w AS (PARTITION BY symbol, session ORDER BY run)) SELECT symbol, count(p1) AS transitions, count(*) FILTER (WHERE p2 = state) AS reversals, round(count(*) FILTER (WHERE p2 = state) / nullif(count(p1), 0), 6) AS rate FROM p GROUP BY 1")
def reversal_rates(spark, d):
    return events.reversal_rate(bars.hourly(spark, d))


@query(RUNS + ", x AS (SELECT state, duration, ending, unnest(range(1, duration + 1)) AS age FROM r), h AS (SELECT state, CAST(age AS INT) AS age, count(*) AS at_risk, count(*) FILTER (WHERE ending = 'exit' AND age = duration) AS exits FROM x GROUP BY 1, 2) SELECT state, age, at_risk, exits, round((exits + 1.0::DOUBLE) / (at_risk + 2), 6) AS hazard, round(exp(sum(ln(1 - (exits + 1.0::DOUBLE) / (at_risk + 2))) OVER (PARTITION BY state ORDER BY age ROWS UNBOUNDED PRECEDING)), 6) AS survival FROM h")
def duration_hazard(spark, d):
    return events.duration_hazard(bars.hourly(spark, d))


@query(RUNS + """, p AS (SELECT symbol, session, run, state, list(state) OVER (PARTITION BY symbol, session ORDER BY run ROWS 4 PRECEDING) AS path FROM r), k AS (SELECT *, list_max(list_filter(range(1, len(path)), lambda i: path[i] = state)) AS back FROM p), w AS (SELECT symbol, session, run, list_slice(path, back, len(path) - 1) AS walk FROM k WHERE back IS NOT NULL), o AS (SELECT symbol, session, run, walk, unnest(range(1, len(walk) + 1)) AS i FROM w WHERE len(walk) > 1)
 SELECT symbol, session, CAST(run AS BIGINT) AS run, array_to_string(min(list_concat(list_slice(walk, i, len(walk)), list_slice(walk, 1, i - 1))), ',') AS loop FROM o GROUP BY symbol, session, run""")
def loop_closures(spark, d):
    return events.closures(bars.hourly(spark, d))


@query("WITH RECURSIVE " + H.removeprefix("WITH ") + """, e AS (SELECT symbol, session, max(high) AS h, min(low) AS l, count(*) AS c FROM b WHERE bar_index < 3 GROUP BY 1, 2), n AS (SELECT b.symbol, b.session, bar_index, close, CASE WHEN bar_index >= 3 AND c >= 3 THEN h END AS h, round(CASE WHEN bar_index >= 3 AND c >= 3 THEN (h + l) / 2 END, 6) AS m, row_number() OVER (PARTITION BY b.symbol, b.session ORDER BY bar_index) AS n FROM b LEFT JOIN e USING (symbol, session)),
 f AS (SELECT symbol, session, bar_index, n, CASE WHEN close > h THEN 1 ELSE 0 END AS position, CASE WHEN close > h THEN 1 ELSE 0 END AS age, false AS done FROM n WHERE n = 1 UNION ALL SELECT n.symbol, n.session, n.bar_index, n.n, CASE WHEN f.position = 1 AND (n.close < n.m OR f.age >= 5) THEN 0 WHEN f.position = 0 AND NOT f.done AND n.close > n.h THEN 1 ELSE f.position END, CASE WHEN f.position = 0 AND NOT f.done AND n.close > n.h THEN 1 WHEN f.position = 1 AND NOT (n.close < n.m OR f.age >= 5) THEN f.age + 1 ELSE f.age END, f.done OR (f.position = 1 AND (n.close < n.m OR f.age >= 5)) FROM f JOIN n ON n.symbol = f.symbol AND n.session = f.session AND n.n = f.n + 1) SELECT symbol, session, bar_index, position FROM f""")
def opening_range_breakout(spark, d):
    return events.breakout_hold(bars.hourly(spark, d))


@query("WITH RECURSIVE " + H.removeprefix("WITH ") + """, n AS (SELECT symbol, session, bar_index, close / (close + open) AS p, row_number() OVER (PARTITION BY symbol, session ORDER BY bar_index) AS n FROM b), f AS (SELECT symbol, session, bar_index, n, CASE WHEN p >= 1 - p THEN 0 ELSE 1 END AS held FROM n WHERE n = 1
 UNION ALL SELECT n.symbol, n.session, n.bar_index, n.n, CASE WHEN greatest(p, 1 - p) >= 0.6 AND greatest(p, 1 - p) - CASE WHEN f.held = 0 THEN p ELSE 1 - p END >= 0.1 THEN CASE WHEN p >= 1 - p THEN 0 ELSE 1 END ELSE f.held END FROM f JOIN n ON n.symbol = f.symbol AND n.session = f.session AND n.n = f.n + 1) SELECT symbol, session, bar_index, held FROM f""")
def hysteresis(spark, d):
    b = bars.hourly(spark, d)
    up = F.col("close") / (F.col("close") + F.col("open"))
    return events.hysteresis(b.select("symbol", "session", "bar_index", F.array(up, 1 - up).alias("p")), ["symbol", "session"], "bar_index", 0.6, 0.1).select("symbol", "session", "bar_index", "held")


# joins

QUOTES = "q AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view'), t AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'click')"


def _quotes(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", "event_id", "value", "event_type")
    return e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'view'").drop("event_type")


@query(f"WITH {QUOTES} SELECT t.event_id, t.value, q.event_id AS asof_event_id, q.value AS asof_value FROM t ASOF LEFT JOIN q ON t.user_id = q.user_id AND t.ts >= q.ts")
def asof_quote(spark, d):
    trades, quotes = _quotes(spark, d)
    return joins.asof(trades, quotes, ["user_id"], ["ts", "event_id"], ["value"]).select("event_id", "value", "asof_event_id", "asof_value")


@query(f"WITH {QUOTES}, x AS (SELECT t.event_id, q.value AS v, row_number() OVER (PARTITION BY t.event_id ORDER BY q.ts DESC) AS k FROM t LEFT JOIN q ON t.user_id = q.user_id AND q.ts < t.ts) SELECT event_id, max(CASE WHEN k = 1 THEN v END) AS prior_1, max(CASE WHEN k = 2 THEN v END) AS prior_2 FROM x GROUP BY 1")
def asof_strict_last2(spark, d):
    trades, quotes = _quotes(spark, d)
    return joins.prior_k(trades.select("user_id", "ts", "event_id"), quotes, ["user_id"], ["ts"], "value").select("event_id", "prior_1", "prior_2")


@query(f"WITH {QUOTES} SELECT t.event_id, CASE WHEN q.value IS NULL OR epoch(t.ts) - epoch(q.ts) > 86400 THEN 'UNCLASSIFIED' WHEN t.value >= q.value * 1.01 THEN 'BUY' WHEN t.value <= q.value * 0.99 THEN 'SELL' ELSE 'UNKNOWN' END AS side FROM t ASOF LEFT JOIN q ON t.user_id = q.user_id AND t.ts >= q.ts")
def trade_side(spark, d):
    trades, quotes = _quotes(spark, d)
    j = joins.asof(trades, quotes, ["user_id"], ["ts", "event_id"], ["value"])
    age = F.col("ts").cast("timestamp").cast("double") - F.col("asof_ts").cast("timestamp").cast("double")
    q = F.col("asof_value")
    side = F.when(q.isNull() | (age > 86400), "UNCLASSIFIED").when(F.col("value") >= q * 1.01, "BUY").when(F.col("value") <= q * 0.99, "SELL").otherwise("UNKNOWN")
    return j.select("event_id", side.alias("side"))


@query("WITH s AS (SELECT p_brand AS brand, p_partkey AS k, p_retailprice - 5 AS lo, p_retailprice + 5 AS hi FROM part) SELECT p.p_partkey, s.k FROM part p JOIN s ON p.p_brand = s.brand AND s.lo <= p.p_retailprice AND p.p_retailprice < s.hi")
def interval_join(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), "p_retailprice")
    s = p.select("brand", F.col("p_partkey").alias("k"), (F.col("p_retailprice") - 5).alias("lo"), (F.col("p_retailprice") + 5).alias("hi"))
    return joins.interval_join(p, s, ["brand"], "p_retailprice", "lo", "hi", 10.0, copies=True).select("p_partkey", "k")


@query("WITH t AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1 AS s FROM customer WHERE c_acctbal < 0), c AS (SELECT c_nationkey, c_mktsegment, c_custkey, (row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1) // 2 AS s FROM customer WHERE c_acctbal >= 0) SELECT t.c_custkey, c.c_custkey AS control_c_custkey FROM t JOIN c USING (c_nationkey, c_mktsegment, s)")
def matched_controls(spark, d):
    c = _t(spark, d, "customer")
    return joins.matched_controls(c.where("c_acctbal < 0"), c.where("c_acctbal >= 0"), ["c_nationkey", "c_mktsegment"], ["c_custkey"]).select("c_custkey", "control_c_custkey")


@query("WITH a AS (SELECT o_custkey AS k, count(*) AS na FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS nb FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, na, nb, CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k")
def paired_full_outer(spark, d):
    o = _t(spark, d, "orders")
    part = lambda s, n: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias(n))
    return joins.paired(part("F", "na"), part("O", "nb"), ["k"])


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join(spark, d):
    return _t(spark, d, "customer").select("c_custkey").join(_t(spark, d, "orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, d):
    return _t(spark, d, "customer").select("c_custkey").join(_t(spark, d, "orders").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer EXCEPT SELECT s_suppkey FROM supplier")
def set_operations(spark, d):
    o, c, s = _t(spark, d, "orders").select(F.col("o_custkey").alias("k")), _t(spark, d, "customer").select("c_custkey"), _t(spark, d, "supplier").select("s_suppkey")
    return o.union(c).distinct().subtract(s)


# aggregates and metrics


@query("WITH u AS (SELECT l_returnflag, l_suppkey, greatest(least(round(avg(l_discount * 100 - l_tax * 100), 9), 2.0), -2.0) AS x FROM lineitem GROUP BY 1, 2), m AS (SELECT l_returnflag, median(x) AS m FROM u GROUP BY 1) SELECT l_returnflag, count(*) AS units, round(max(m), 6) AS median, round(median(abs(x - m)) * 1.4826, 6) AS mad, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM u JOIN m USING (l_returnflag) GROUP BY 1")
def session_payoff_two_stage(spark, d):
    fills = _t(spark, d, "lineitem").withColumn("payoff", F.col("l_discount") * 100 - F.col("l_tax") * 100)
    return metrics.two_stage(fills, ["l_returnflag"], "l_suppkey", "payoff", 2.0)


@query("SELECT l_linestatus, l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linestatus, l_returnflag), ())")
def grouping_sets_breakdown(spark, d):
    return metrics.breakdowns(_t(spark, d, "lineitem"), [["l_returnflag"], ["l_linestatus"], ["l_linestatus", "l_returnflag"], []], "l_quantity")


@query("WITH g AS (SELECT l_suppkey, sum(l_extendedprice * l_discount) AS v FROM lineitem GROUP BY 1) SELECT l_suppkey, round(v, 3) AS total, round(abs(v) / (SELECT sum(abs(v)) FROM g), 6) AS share FROM g")
def concentration(spark, d):
    return metrics.concentration(_t(spark, d, "lineitem").withColumn("gain", F.col("l_extendedprice") * F.col("l_discount")), "l_suppkey", "gain")


@query("WITH g AS (SELECT l_suppkey, sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, round(((SELECT sum(s) FROM g) - s) / ((SELECT sum(n) FROM g) - n), 6) AS mean_without FROM g")
def leave_one_out_group(spark, d):
    return metrics.leave_one_out(_t(spark, d, "lineitem"), "l_suppkey", "l_quantity")


@query("""WITH g AS (SELECT l_returnflag, l_quantity AS v, CAST(sum(CAST(l_linenumber AS DOUBLE)) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2), p AS (SELECT *, (sum(w) OVER o - w / 2) / sum(w) OVER (PARTITION BY l_returnflag) AS p FROM g WINDOW o AS (PARTITION BY l_returnflag ORDER BY v)), i AS (SELECT *, lag(v) OVER o AS pv, lag(p) OVER o AS pp FROM p WINDOW o AS (PARTITION BY l_returnflag ORDER BY v))
 SELECT l_returnflag, round(max(CASE WHEN pp < 0.3 AND p >= 0.3 THEN pv + (v - pv) * (0.3 - pp) / (p - pp) WHEN pp IS NULL AND p >= 0.3 THEN v END), 6) AS quantile FROM i GROUP BY 1""")
def weighted_quantile(spark, d):
    return metrics.weighted_quantile(_t(spark, d, "lineitem").withColumn("w", F.col("l_linenumber").cast("double")), ["l_returnflag"], "l_quantity", "w", 0.3)


SCORES = "WITH s AS (SELECT quality AS y, n_chars AS x, 1 / (1 + exp(-(n_chars - 1500) / 1000.0)) AS p FROM labels JOIN documents USING (doc_id))"


def _scores(spark, d):
    j = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select(F.col("quality").alias("y"), F.col("n_chars").alias("x"), (1 / (1 + F.exp(-(F.col("n_chars") - 1500) / 1000))).alias("p"))


@query(SCORES + ", c AS (SELECT x, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS n FROM s GROUP BY 1) SELECT round(sum(a.p * (coalesce((SELECT sum(n) FROM c b WHERE b.x < a.x), 0) + a.n / 2)) / (sum(a.p) * sum(a.n)), 6) AS auc FROM c a")
def auc(spark, d):
    return metrics.auc(_scores(spark, d), "x", "y")


@query(SCORES + " SELECT count(*) AS n, round(avg((greatest(least(p, 1 - 1e-6), 1e-6) - y) ** 2), 6) AS brier, round(avg(-(y * ln(greatest(least(p, 1 - 1e-6), 1e-6)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-6), 1e-6)))), 6) AS logloss FROM s")
def brier_logloss(spark, d):
    return metrics.brier_logloss(_scores(spark, d), "p", "y")


@query(SCORES + ", b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS p, avg(y) AS y FROM s GROUP BY 1) SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM b")
def ece(spark, d):
    return metrics.calibration_error(_scores(spark, d), "p", "y")


@query("WITH t AS (SELECT p_brand, p_partkey, p_size / 100.0::DOUBLE AS p FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM t) SELECT p_brand, p_partkey, p, round(least(min(p * n / r) OVER (PARTITION BY p_brand ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 1.0), 6) AS adjusted FROM r")
def bh_adjust(spark, d):
    return metrics.benjamini_hochberg(_t(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_size") / 100.0).alias("p")), "p", ["p_brand"])


# back-test

SMA = D + f""", m AS (SELECT *, row_number() {WD}) AS n, round(avg(close) {WD} ROWS 4 PRECEDING), 6) AS f, round(avg(close) {WD} ROWS 19 PRECEDING), 6) AS s FROM b), p AS (SELECT symbol, session, close, CASE WHEN n >= 20 AND f > s THEN 1.0 ELSE 0.0 END::DOUBLE AS position FROM m)"""
EVAL = f""", e0 AS (SELECT *, coalesce(close / lag(close) {WD}) - 1, 0) AS mv, coalesce(lag(position) {WD}), 0) AS held FROM p), e AS (SELECT symbol, session, position, held * mv AS gross, abs(position - held) AS turnover, held * mv - abs(position - held) * 5.0 / 10000 AS net FROM e0)"""


@query(SMA + " SELECT symbol, session, position FROM p")
def sma_positions(spark, d):
    return backtest.sma(bars.daily(spark, d)).select("symbol", "session", "position")


@query(D + f", r AS (SELECT *, row_number() {WD}) AS n, max(high) {WD} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS h, min(low) {WD} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS l FROM b), s AS (SELECT *, CASE WHEN n >= 21 AND close > h THEN 1.0 WHEN n >= 21 AND close < l THEN 0.0 END::DOUBLE AS raw FROM r) SELECT symbol, session, coalesce(last_value(raw IGNORE NULLS) {WD} ROWS UNBOUNDED PRECEDING), 0.0) AS position FROM s")
def breakout_positions(spark, d):
    return backtest.breakout(bars.daily(spark, d)).select("symbol", "session", "position")


@query(D + f", r AS (SELECT *, row_number() {WD}) AS n, avg(close) {WD} ROWS 9 PRECEDING) AS m, stddev_samp(close) {WD} ROWS 9 PRECEDING) AS sd FROM b), s AS (SELECT *, CASE WHEN n >= 10 AND sd > 0 THEN round((close - m) / sd, 6) END AS z FROM r), t AS (SELECT *, CASE WHEN z <= -1 THEN 1.0 WHEN z >= 0 THEN 0.0 END::DOUBLE AS raw FROM s) SELECT symbol, session, coalesce(last_value(raw IGNORE NULLS) {WD} ROWS UNBOUNDED PRECEDING), 0.0) AS position FROM t")
def mean_reversion_positions(spark, d):
    return backtest.mean_reversion(bars.daily(spark, d)).select("symbol", "session", "position")


@query(SMA + EVAL + " SELECT symbol, session, position, round(gross, 6) AS gross, turnover, round(net, 6) AS net FROM e")
def backtest_eval(spark, d):
    r = backtest.evaluated(backtest.sma(bars.daily(spark, d)))
    return r.withColumns({"gross": six(F.col("gross")), "net": six(F.col("net"))})


@query("SELECT * FROM (" + D + ", n AS (SELECT symbol, count(*) AS n FROM b GROUP BY 1) SELECT symbol, CAST(i AS INT) AS split, CAST(i * 60 AS INT) AS train_start, CAST(i * 60 + 250 AS INT) AS train_end, CAST(i * 60 + 255 AS INT) AS test_start, CAST(i * 60 + 315 AS INT) AS test_end FROM n, range(0, 1000) t(i) WHERE i * 60 + 315 <= n)")
def walk_forward_splits(spark, d):
    return backtest.splits(bars.daily(spark, d))


WFS = D + ", n0 AS (SELECT symbol, count(*) AS n FROM b GROUP BY 1), g AS (" + " UNION ALL ".join(f"SELECT symbol, session, close, {i} AS param, CASE WHEN row_number() {WD}) >= {s} AND round(avg(close) {WD} ROWS {f - 1} PRECEDING), 6) > round(avg(close) {WD} ROWS {s - 1} PRECEDING), 6) THEN 1.0 ELSE 0.0 END::DOUBLE AS position FROM b" for i, (f, s) in enumerate([(3, 10), (5, 20), (10, 40)])) + """), e0 AS (SELECT *, coalesce(close / lag(close) OVER w - 1, 0) AS mv, coalesce(lag(position) OVER w, 0) AS held, row_number() OVER w - 1 AS r FROM g WINDOW w AS (PARTITION BY symbol, param ORDER BY session)), e AS (SELECT *, held * mv - abs(position - held) * 5.0 / 10000 AS net FROM e0),
 s AS (SELECT symbol, CAST(i AS INT) AS split, i * 60 AS a FROM n0, range(0, 1000) t(i) WHERE i * 60 + 315 <= n), t AS (SELECT symbol, split, param, round(sum(CASE WHEN r < a + 250 THEN net ELSE 0 END), 9) AS train_net, sum(CASE WHEN r >= a + 255 THEN net ELSE 0 END) AS test_net FROM e JOIN s USING (symbol) WHERE r >= a AND r < a + 315 GROUP BY 1, 2, 3)"""


@query(WFS + " SELECT symbol, split, param, round(train_net, 6) AS train_net, round(test_net, 6) AS test_net FROM t QUALIFY row_number() OVER (PARTITION BY symbol, split ORDER BY train_net DESC, param) = 1")
def walk_forward_selection(spark, d):
    return backtest.walk_forward(bars.daily(spark, d), [(3, 10), (5, 20), (10, 40)])


CALM = D.replace("o_totalprice", "(300000 + o_totalprice / 10)")
BREAKOUT = CALM + f", r AS (SELECT *, row_number() {WD}) AS n, max(high) {WD} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS h, min(low) {WD} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS l FROM b), s AS (SELECT *, CASE WHEN n >= 21 AND close > h THEN 1.0 WHEN n >= 21 AND close < l THEN 0.0 END::DOUBLE AS raw FROM r), p AS (SELECT symbol, session, close, coalesce(last_value(raw IGNORE NULLS) {WD} ROWS UNBOUNDED PRECEDING), 0.0) AS position FROM s)"


@query(BREAKOUT + EVAL + f", q AS (SELECT *, exp(sum(ln(1 + net)) {WD} ROWS UNBOUNDED PRECEDING)) AS eq FROM e), k AS (SELECT *, max(eq) {WD} ROWS UNBOUNDED PRECEDING) AS pk FROM q) SELECT symbol, round(exp(sum(ln(1 + net))) - 1, 5) AS compound, round(sum(greatest(gross, 0)) / -sum(least(gross, 0)), 5) AS profit_factor, round(avg(abs(position)), 6) AS exposure, count(*) FILTER (WHERE turnover > 0) AS trades, round(avg(net) / stddev_samp(net) * sqrt(252), 5) AS sharpe, round(min(eq / pk - 1), 5) AS max_drawdown FROM k GROUP BY 1")
def backtest_summary(spark, d):
    # calmer prices than the orders' own, so that compounded returns stay comparable
    b = bars.daily(spark, d).withColumns({c: 300000 + F.col(c) / 10 for c in ("open", "high", "low", "close")})
    return backtest.summary(backtest.evaluated(backtest.breakout(b)))


# options, vectors, text


@query("WITH c AS (SELECT p_brand AS root, p_size AS strike, CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS side, min(p_retailprice) AS price FROM part GROUP BY ALL), j AS (SELECT a.root, a.strike, a.price AS call, b.price AS put FROM c a JOIN c b ON a.root = b.root AND a.strike = b.strike AND a.side = 'call' AND b.side = 'put') SELECT root, arg_min(strike, abs(strike - 25) * 1000 + strike) AS strike, arg_min(round(call + put, 6), abs(strike - 25) * 1000 + strike) AS straddle FROM j GROUP BY 1")
def chain_atm_pair(spark, d):
    return options.at_the_money(options.chain(_t(spark, d, "part")), 25)


@query("SELECT root, strike, round(price - nxt, 6) AS debit, round(least(greatest(30 - strike, 0), ns - strike) - (price - nxt), 6) AS pnl FROM (SELECT *, lead(price) OVER w AS nxt, lead(strike) OVER w AS ns FROM (SELECT p_brand AS root, p_size AS strike, min(p_retailprice) AS price FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2) WINDOW w AS (PARTITION BY root ORDER BY strike)) WHERE nxt IS NOT NULL")
def spread_pnl(spark, d):
    return options.vertical_spreads(options.chain(_t(spark, d, "part")), 30)


@query("WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT i, median(v) AS m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS q FROM x GROUP BY 1) SELECT vec_id, round(1 / (1 + exp(-sum(greatest(least(CASE WHEN q > 0 THEN (v - m) / q ELSE 0 END, 5), -5) / i))), 4) AS score FROM x JOIN m USING (i) GROUP BY 1")
def scale_and_score(spark, d):
    return text.scaled_score(_t(spark, d, "embeddings"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '(?:password|token|secret)\\s*[=:]\\s*\"?[A-Za-z0-9]+\"?', '[REDACTED]', 'g'), '\\b[0-9a-f]{16,}\\b', '[REDACTED]', 'g') AS text FROM documents")
def redact_text(spark, d):
    return text.redact(_t(spark, d, "documents").select("doc_id", "text"))


@query("SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS hits FROM documents WHERE contains(text, 'the')")
def search_text(spark, d):
    return text.search(_t(spark, d, "documents").select("doc_id", "text"), "the")


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY 1")
def json_props(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))


@query("SELECT c_custkey, sha256(concat_ws('|', c_name, c_mktsegment, c_nationkey)) AS id FROM customer")
def hash_identity(spark, d):
    return _t(spark, d, "customer").select("c_custkey", F.sha2(F.concat_ws("|", "c_name", "c_mktsegment", "c_nationkey"), 256).alias("id"))


# streaming, run to the end over the table's files


@query(H + " SELECT symbol, session, bar_index, open, high, low, close, volume FROM b")
def stream_bars(spark, d):
    return streams.drained(spark, d)


# the other families register themselves

from strandline.plans import access, chains, checks, inference, live, micro, models, outcomes, panels, research, structure, summaries, trajectories  # noqa: E402, F401
