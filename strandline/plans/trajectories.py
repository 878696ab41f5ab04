"""Queries of further features."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.numbers import log, ratio
from strandline.functions.windows import ordered
from strandline.operators import features, trajectories
from strandline.plans.registry import H, RUNS, W, WD, D, query
from strandline.sources import bars

SESSION = ["symbol", "session"]
UP = f"{W} ROWS UNBOUNDED PRECEDING)"


@query(H + f", c AS (SELECT symbol, session, bar_index, bar_index * 60 AS o, (max(bar_index) OVER (PARTITION BY symbol, session) - bar_index) * 60 AS c FROM b) SELECT *, o >= 60 AS after_buffer, c > 180 AS before_cutoff, o >= 0 AND o < 180 AS in_opening, o >= 600 AND o < 840 AS in_midday, o >= 1080 AS in_late, c <= 180 AS no_entry, c <= 60 AS must_flatten, o >= 60 AND c > 180 AND NOT c <= 60 AS can_open FROM c")
def time_window_flags(spark, d):
    from pyspark.sql import Window

    b = bars.hourly(spark, d).select(*SESSION, "bar_index", (F.col("bar_index") * 60).alias("o"), ((F.max("bar_index").over(Window.partitionBy(*SESSION)) - F.col("bar_index")) * 60).alias("c"))
    return trajectories.time_flags(b, "o", "c")


@query(H + f" SELECT symbol, session, bar_index, row_number() {W}) - 1 >= 5 AS enough_bars FROM b")
def minimum_bars(spark, d):
    return trajectories.minimum_bars(bars.hourly(spark, d), 5).select(*SESSION, "bar_index", "enough_bars")


def _frame(spark, d):
    """The features of one bar side by side: joins on the bar's key."""
    b, key = bars.hourly(spark, d), [*SESSION, "bar_index"]
    parts = [features.session_vwap(b).select(*key, "vwap"), features.opening_range(b).select(*key, "or_mid"), features.relative_volume(b).select(*key, "relative_volume"), features.range_compression(b).select(*key, "compression_z")]
    out = b.select(*key, "close")
    for p in parts:
        out = out.join(p, key)
    return out


FR = H + f", v AS (SELECT *, sum((high + low + close) / 3 * volume) {UP} / sum(volume) {UP} AS vw, avg(volume) OVER p AS m, count(volume) OVER p AS mn, max(high) {W} ROWS 2 PRECEDING) - min(low) {W} ROWS 2 PRECEDING) AS r, count(*) FILTER (WHERE bar_index < 3) OVER (PARTITION BY symbol, session) AS oc, max(high) FILTER (WHERE bar_index < 3) OVER (PARTITION BY symbol, session) AS oh, min(low) FILTER (WHERE bar_index < 3) OVER (PARTITION BY symbol, session) AS ol FROM b WINDOW p AS (PARTITION BY symbol, bar_index ORDER BY session ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)), z AS (SELECT *, avg(r) {W} ROWS 5 PRECEDING) AS rm, stddev_samp(r) {W} ROWS 5 PRECEDING) AS rs FROM v), f AS (SELECT symbol, session, bar_index, close, round(vw, 6) AS vwap, round(CASE WHEN bar_index >= 3 AND oc >= 3 THEN (oh + ol) / 2 END, 6) AS or_mid, round(CASE WHEN mn >= 5 AND m > 0 THEN volume / m END, 6) AS relative_volume, round(CASE WHEN rs > 0 THEN (r - rm) / rs END, 4) AS compression_z FROM z)"


@query(FR + " SELECT * FROM f")
def intraday_frame(spark, d):
    return _frame(spark, d)


@query(FR + ", s AS (SELECT symbol, session, count(*) AS n, count(*) FILTER (WHERE vwap IS NULL) AS a, count(*) FILTER (WHERE or_mid IS NULL) AS b, count(*) FILTER (WHERE relative_volume IS NULL) AS c FROM f GROUP BY 1, 2) SELECT symbol, CAST(sum(n) AS BIGINT) AS rows, count(*) AS sessions, count(*) FILTER (WHERE n < 24) AS incomplete, round(sum(a) / sum(n), 6) AS null_vwap, round(sum(b) / sum(n), 6) AS null_or_mid, round(sum(c) / sum(n), 6) AS null_relative_volume FROM s GROUP BY 1")
def feature_report(spark, d):
    return trajectories.feature_report(_frame(spark, d), ["vwap", "or_mid", "relative_volume"], 24)


SEG = H + f", g AS (SELECT *, bar_index - lag(bar_index) {W}) AS gp FROM b), s AS (SELECT *, sum(CASE WHEN coalesce(gp <> 1, false) THEN 1 ELSE 0 END) {UP} AS sg FROM g), a AS (SELECT symbol, session, sg, min(bar_index) AS st, max(bar_index) AS en, count(*) AS bars, max(CASE WHEN gp <> 1 THEN gp - 1 END) AS mb FROM s GROUP BY 1, 2, 3)"


@query(SEG + " SELECT symbol, session, printf('%s::%s::segment_%02d', symbol, session, CAST(sg AS BIGINT) + 1) AS segment_id, st AS start, en AS \"end\", bars, CASE WHEN sg > 0 THEN 'source_gap' WHEN st = 0 THEN 'session_open' ELSE 'late_open' END AS start_reason, CASE WHEN lead(st) OVER (PARTITION BY symbol, session ORDER BY sg) IS NOT NULL THEN 'source_gap' WHEN en = 23 THEN 'scheduled_session_end' ELSE 'early_end' END AS end_reason, coalesce(mb, 0) AS missing_before FROM a")
def causal_segments(spark, d):
    return trajectories.causal_segments(bars.hourly(spark, d), 24)


P = "OVER (PARTITION BY symbol, session, sg ORDER BY bar_index"
SY = H + f", g AS (SELECT *, bar_index - lag(bar_index) {W}) AS gp FROM b), s AS (SELECT *, sum(CASE WHEN coalesce(gp <> 1, false) THEN 1 ELSE 0 END) {UP} AS sg FROM g), x AS (SELECT *, ln(close / lag(close) {P})) AS r FROM s)"


@query(SY + f" SELECT symbol, session, bar_index, round(r, 6) AS log_return, round(CASE WHEN count(r) {P} ROWS 2 PRECEDING) >= 3 THEN sum(r) {P} ROWS 2 PRECEDING) END, 6) AS sum_3, round(CASE WHEN count(r) {P} ROWS 5 PRECEDING) >= 6 THEN sum(r) {P} ROWS 5 PRECEDING) END, 6) AS sum_6, round(CASE WHEN count(r) {P} ROWS 5 PRECEDING) >= 6 THEN stddev_samp(r) {P} ROWS 5 PRECEDING) END, 5) AS sd_6, round(CASE WHEN count(r) {P} ROWS 5 PRECEDING) >= 6 THEN sum(r) {P} ROWS 5 PRECEDING) / nullif(sum(abs(r)) {P} ROWS 5 PRECEDING), 0) END, 5) AS efficiency, round(CASE WHEN count(volume) OVER v >= 10 THEN volume / avg(volume) OVER v END, 6) AS relative_volume FROM x WINDOW v AS (PARTITION BY symbol, bar_index ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def symbol_features(spark, d):
    return trajectories.symbol_features(bars.hourly(spark, d))


@query(H + " SELECT symbol, session, bar_index, round(ln(1 + greatest(volume, 0)), 6) AS emit_volume, round(tanh(close / open - 1), 6) AS emit_move, round((high - low) / (1 + abs(high - low)), 6) AS emit_span FROM b")
def emission_features(spark, d):
    b = bars.hourly(spark, d).select(*SESSION, "bar_index", "volume", (F.col("close") / F.col("open") - 1).alias("move"), (F.col("high") - F.col("low")).alias("span"))
    return trajectories.emissions(b, {"volume": "log1p", "move": "tanh", "span": "ratio"}).select(*SESSION, "bar_index", "emit_volume", "emit_move", "emit_span")


MC = D + f", r AS (SELECT *, close / lag(close) {WD}) - 1 AS r FROM b), f AS (SELECT session, CASE WHEN count(close) OVER w >= 20 THEN close / avg(close) OVER w - 1 END AS tr, CASE WHEN count(close) OVER w >= 20 THEN close / max(close) OVER w - 1 END AS hi, CASE WHEN count(r) OVER w >= 20 THEN stddev_samp(r) OVER w END AS vo FROM r WINDOW w AS (PARTITION BY symbol ORDER BY session ROWS 19 PRECEDING)), m AS (SELECT session, count(tr) AS peers, median(tr) AS tr, median(hi) AS hi, median(vo) AS vo FROM f GROUP BY 1 HAVING count(tr) >= 3), l AS (SELECT session, peers, lag(tr) OVER o AS tr, lag(hi) OVER o AS hi, lag(vo) OVER o AS vo FROM m WINDOW o AS (ORDER BY session))"


@query(MC + " SELECT session, peers, round(tr, 5) AS trend, round(hi, 5) AS high, round(vo, 5) AS vol, round(avg(tr + hi) OVER (ORDER BY session ROWS 14 PRECEDING), 5) AS score FROM l")
def market_context(spark, d):
    return trajectories.market_context(bars.daily(spark, d))


CF = "WITH RECURSIVE " + D.removeprefix("WITH ") + ", n AS (SELECT symbol, session, CASE WHEN close > 250000 THEN 1 ELSE 0 END AS st, row_number() OVER (PARTITION BY symbol ORDER BY session) AS n FROM b), f AS (SELECT symbol, session, n, st AS held, st AS cand, 0 AS run, 1 AS age FROM n WHERE n = 1 UNION ALL SELECT x.symbol, x.session, x.n, CASE WHEN ch THEN st ELSE held END, st, CASE WHEN ch THEN 0 ELSE r2 END, CASE WHEN ch THEN 1 ELSE age + 1 END FROM (SELECT n.symbol, n.session, n.n, n.st, f.held, f.age, CASE WHEN n.st = f.held THEN 0 WHEN n.st = f.cand THEN f.run + 1 ELSE 1 END AS r2, n.st <> f.held AND CASE WHEN n.st = f.cand THEN f.run + 1 ELSE 1 END >= 3 AND f.age >= 10 AS ch FROM f JOIN n ON n.symbol = f.symbol AND n.n = f.n + 1) x)"


@query(CF + " SELECT symbol, session, held FROM f")
def confirmed_states(spark, d):
    b = bars.daily(spark, d).select("symbol", "session", (F.col("close") > 250000).cast("int").alias("st"))
    return trajectories.confirmed_states(b, ["symbol"], "session", "st", 3, 10).select("symbol", "session", "held")


@query(H + f", e AS (SELECT symbol, session, CAST(sign(close - open) AS INT) AS state, lead(close) {W}) / close - 1 AS r FROM b), s AS (SELECT symbol, state, session, median(r) AS m FROM e WHERE r IS NOT NULL GROUP BY 1, 2, 3) SELECT symbol, state, session, round(median(m) OVER a, 6) AS median_5, round(avg(m) OVER a, 6) AS mean_5, round(median(m) OVER z, 6) AS median_20, round(avg(m) OVER z, 6) AS mean_20 FROM s WINDOW a AS (PARTITION BY symbol, state ORDER BY session ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), z AS (PARTITION BY symbol, state ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def state_efficacy(spark, d):
    b = bars.hourly(spark, d)
    e = b.select(*SESSION, F.signum(F.col("close") - F.col("open")).cast("int").alias("state"), (F.lead("close").over(ordered(SESSION, ["bar_index"])) / F.col("close") - 1).alias("r")).where("r is not null")
    return trajectories.state_efficacy(e, ["symbol", "state"], "session", "r", (5, 20))


@query(H + ", x AS (SELECT symbol, session, bar_index, round(10000 * (close / open - 1), 4) AS v FROM b) SELECT symbol, session, bar_index, v, round((SELECT median(y.v) FROM x y WHERE y.session = x.session AND y.bar_index = x.bar_index AND y.symbol <> x.symbol), 6) AS others, round(v - (SELECT median(y.v) FROM x y WHERE y.session = x.session AND y.bar_index = x.bar_index AND y.symbol <> x.symbol), 6) AS residual FROM x")
def cohort_residuals(spark, d):
    b = bars.hourly(spark, d).select(*SESSION, "bar_index", F.round(10000 * (F.col("close") / F.col("open") - 1), 4).alias("v"))
    return trajectories.cohort_residuals(b, ["session", "bar_index"], "v")


CP = H + f", x AS (SELECT symbol, session, bar_index, close, unnest([{{'s': 1, 'c': l1}}, {{'s': 2, 'c': l2}}]) AS q FROM (SELECT *, lead(close, 1) {W}) AS l1, lead(close, 2) {W}) AS l2 FROM b)), m AS (SELECT symbol, session, bar_index, q.s AS step, 10000 * (q.c / close - 1) AS v FROM x WHERE q.c IS NOT NULL), o AS (SELECT m.symbol, m.session, m.bar_index, m.step, any_value(m.v) AS v, median(y.v) AS md FROM m LEFT JOIN m y ON y.session = m.session AND y.bar_index = m.bar_index AND y.step = m.step AND y.symbol <> m.symbol GROUP BY 1, 2, 3, 4)"


@query(CP + " SELECT symbol, session, bar_index, CAST(step AS INT) AS step, round(v, 4) AS move, round(md, 6) AS others FROM o")
def cohort_paths(spark, d):
    p = trajectories.cohort_paths(bars.hourly(spark, d), 2)
    return p.select(*SESSION, "bar_index", "step", F.round("move", 4).alias("move"), "others")


MO = RUNS + ", p AS (SELECT *, lag(state, 1) OVER w AS p1, lag(state, 2) OVER w AS p2, lag(state, 3) OVER w AS p3, lag(state, 4) OVER w AS p4 FROM r WINDOW w AS (PARTITION BY symbol, session ORDER BY run)), m AS (SELECT *, CASE WHEN p2 IS NOT NULL THEN concat_ws('>', p2, p1) END AS m2, CASE WHEN p3 IS NOT NULL THEN concat_ws('>', p3, p2, p1) END AS m3, CASE WHEN p4 IS NOT NULL THEN concat_ws('>', p4, p3, p2, p1) END AS m4 FROM p), k AS (SELECT *, CASE WHEN m2 IS NOT NULL THEN row_number() OVER (PARTITION BY symbol, session, m2 ORDER BY run) - 1 END AS rp FROM m), x AS (SELECT *, unnest(range(s, e + 1)) AS bi FROM k)"


@query(MO + " SELECT symbol, session, CAST(bi AS INT) AS bar_index, state, CAST(bi - s + 1 AS INT) AS age, p1, p2, m2 AS motif_2, m3 AS motif_3, m4 AS motif_4, rp AS repeats FROM x")
def extended_motifs(spark, d):
    return trajectories.extended_motifs(bars.hourly(spark, d))


@query(MO + " SELECT symbol, session, CAST(bi AS INT) AS bar_index, concat_ws(',', p1, p2, p3) AS history FROM x")
def completed_history(spark, d):
    return trajectories.completed_history(bars.hourly(spark, d))


@query(RUNS + ", g AS (SELECT *, coalesce(s - lag(e) OVER w > 1, false) AS fr FROM r WINDOW w AS (PARTITION BY symbol, session ORDER BY run)), q AS (SELECT *, sum(CASE WHEN fr THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, session ORDER BY run ROWS UNBOUNDED PRECEDING) AS segment FROM g) SELECT symbol, session, CAST(segment AS BIGINT) AS segment, CAST(run AS BIGINT) AS run, state, s AS start, e AS \"end\", duration, run = min(run) OVER z AS is_first, run = max(run) OVER z AS is_last FROM q WINDOW z AS (PARTITION BY symbol, session, segment)")
def run_boundaries(spark, d):
    return trajectories.run_boundaries(bars.hourly(spark, d))


VS = H + f", v AS (SELECT symbol, session, bar_index, [ln(close), ln(high / low), volume] AS x FROM b), l AS (SELECT *, lag(x, 1) {W}) AS a, lag(x, 3) {W}) AS c FROM v), d AS (SELECT *, sqrt((x[1] - a[1]) ** 2 + (x[2] - a[2]) ** 2 + (x[3] - a[3]) ** 2) AS ve, sqrt((x[1] - c[1]) ** 2 + (x[2] - c[2]) ** 2 + (x[3] - c[3]) ** 2) AS fa FROM l), q AS (SELECT *, ve - lag(ve) {W}) AS ac, CASE WHEN c IS NOT NULL THEN sum(ve) {W} ROWS 2 PRECEDING) END AS pa FROM d)"


@query(VS + " SELECT symbol, session, bar_index, round(ve, 6) AS velocity, round(ac, 6) AS acceleration, round(pa, 6) AS path, round(fa / nullif(pa, 0), 6) AS consistency FROM q")
def trajectory_features(spark, d):
    v = bars.hourly(spark, d).select(*SESSION, "bar_index", F.array(log("close"), log(ratio("high", "low")), "volume").alias("x"))
    return trajectories.vector_steps(v, SESSION, "bar_index", "x")


RO = H + f", o AS (SELECT symbol, session, bar_index, close, volume, count(*) OVER p >= 4 AS ok, median(close) OVER p AS mc, median(volume) OVER p AS mv, abs(close - lag(close) {W})) + abs(volume - lag(volume) {W})) AS st FROM b WINDOW p AS (PARTITION BY symbol, session ORDER BY bar_index ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)), s AS (SELECT *, sum(st) {W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) <= 300 AS calm FROM o)"


@query(RO + " SELECT symbol, session, bar_index, round(CASE WHEN ok THEN mc END, 6) AS origin_close, round(CASE WHEN ok THEN mv END, 6) AS origin_volume, ok AS eligible FROM s")
def robust_origins(spark, d):
    return trajectories.robust_origins(bars.hourly(spark, d), SESSION, "bar_index", ["close", "volume"], 4)


@query(RO + " SELECT symbol, session, bar_index, round(CASE WHEN ok AND calm THEN mc END, 6) AS origin_close, round(CASE WHEN ok AND calm THEN mv END, 6) AS origin_volume, coalesce(ok AND calm, false) AS eligible FROM s")
def stable_origins(spark, d):
    return trajectories.robust_origins(bars.hourly(spark, d), SESSION, "bar_index", ["close", "volume"], 4, 300.0)


@query(H + f", l AS (SELECT *, coalesce(lag(close) {W}), open) AS l FROM b) SELECT symbol, session, bar_index, round(10000 * (close - l) / l, 4) AS return_bps, round(10000 * (greatest(high, l) - least(low, l)) / l, 4) AS true_range, round(coalesce((close - low) / nullif(high - low, 0), 0.5), 6) AS close_location, round(10000 * (high - greatest(open, close)) / l, 4) AS upper_wick, round(10000 * (least(open, close) - low) / l, 4) AS lower_wick FROM l")
def bar_components(spark, d):
    return trajectories.bar_components(bars.hourly(spark, d))


@query(H + ", g AS (SELECT symbol, session, count(*) AS n, arg_min(open, bar_index) AS o, arg_max(close, bar_index) AS c, max(high) AS h, min(low) AS l, sum(abs(close - open)) AS w, regr_slope(close, bar_index) AS sl, avg(CASE WHEN close > open THEN 1.0 ELSE 0.0 END) AS rs FROM b WHERE bar_index < 6 GROUP BY 1, 2) SELECT symbol, session, round(10000 * (c / o - 1), 4) AS return_bps, round(10000 * (h - l) / o, 4) AS range_bps, round(coalesce(abs(c - o) / nullif(w, 0), 0), 6) AS efficiency, round(sl, 5) AS slope, round(rs, 6) AS rising FROM g WHERE n = 6")
def opening_components(spark, d):
    return trajectories.opening_components(bars.hourly(spark, d), 6)


@query(H + f", p AS (SELECT *, sum(sign(close - open) * volume) {UP} AS p, CAST(row_number() {W}) AS DOUBLE) AS n FROM b) SELECT symbol, session, bar_index, p AS pressure, round(CASE WHEN count(p) OVER w >= 5 THEN regr_slope(p, n) OVER w END, 6) AS slope FROM p WINDOW w AS (PARTITION BY symbol, session ORDER BY bar_index ROWS 4 PRECEDING)")
def pressure_slope(spark, d):
    return trajectories.pressure_slope(bars.hourly(spark, d), 5)


@query(H + f", x AS (SELECT *, CASE WHEN high > max(high) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS a, CASE WHEN low < min(low) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS z FROM b) SELECT symbol, session, bar_index, CAST(sum(a) {W} ROWS 3 PRECEDING) AS BIGINT) AS new_highs, CAST(sum(z) {W} ROWS 3 PRECEDING) AS BIGINT) AS new_lows FROM x")
def new_extremes(spark, d):
    return trajectories.new_extremes(bars.hourly(spark, d), 4)


@query(H + f", x AS (SELECT *, list(close) {W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS l FROM b), s AS (SELECT *, list_filter(list_transform(l, lambda v: CASE WHEN v / close - 1 >= 0.5 THEN 1 WHEN v / close - 1 <= -0.5 THEN -1 ELSE 0 END), lambda v: v <> 0) AS h FROM x WHERE len(l) = 3) SELECT symbol, session, bar_index, coalesce(h[1], 0) AS onset FROM s")
def barrier_onset(spark, d):
    return trajectories.onset(bars.hourly(spark, d), 5000.0)


@query(D + f", r AS (SELECT symbol, session, close / lag(close) {WD}) - 1 AS r FROM b), m AS (SELECT symbol, r, avg(r) OVER (PARTITION BY session) AS m FROM r WHERE r IS NOT NULL) SELECT symbol, count(*) AS n, round(regr_slope(r, m), 5) AS beta, round(regr_intercept(r, m), 5) AS alpha FROM m GROUP BY 1 HAVING count(*) >= 100")
def rolling_beta(spark, d):
    return trajectories.market_betas(bars.daily(spark, d), ["symbol"], ["session"], 100)


@query(H + " SELECT symbol, session, bar_index, round(CASE WHEN count(volume) OVER w >= 10 AND avg(volume) OVER w > 1e-12 THEN volume / avg(volume) OVER w END, 6) AS relative_activity FROM b WINDOW w AS (PARTITION BY symbol, bar_index ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def activity_baseline(spark, d):
    return trajectories.activity_baseline(bars.hourly(spark, d))


@query(H + ", x AS (SELECT b.*, c, n FROM b, (SELECT unnest([6, 12, 18]) AS c), (SELECT unnest([2, 5]) AS n) WHERE bar_index < c AND bar_index >= c - n) SELECT symbol, session, CAST(c AS INT) AS checkpoint, CAST(n AS INT) AS length, round(CASE WHEN count(*) = n THEN ln(arg_max(close, bar_index) / arg_min(open, bar_index)) END, 6) AS ret, round(CASE WHEN count(*) = n THEN ln(max(high) / min(low)) END, 6) AS span FROM x GROUP BY 1, 2, c, n")
def entry_windows(spark, d):
    return trajectories.entry_windows(bars.hourly(spark, d), (6, 12, 18), (2, 5))


OL = H + f", x AS (SELECT *, round(close / first_value(open) {UP} - 1, 9) AS ret FROM b), k AS (SELECT symbol, session, bar_index, close, ret, row_number() OVER (PARTITION BY session, bar_index ORDER BY ret DESC, symbol) AS rank FROM x WHERE bar_index IN (5, 9, 15, 20))"


@query(OL + " SELECT symbol, session, bar_index, close, round(ret, 6) AS ret, rank FROM k")
def opening_leaders(spark, d):
    return trajectories.opening_leaders(bars.hourly(spark, d), (5, 9, 15, 20)).withColumn("ret", F.round("ret", 6))


@query(OL + ", f AS (SELECT session, symbol AS leader, close AS sp FROM k WHERE bar_index = 5 AND rank = 1), m AS (SELECT *, median(ret) OVER (PARTITION BY session, bar_index) AS md FROM k) SELECT m.session, bar_index, leader, rank, rank <= 2 AS top_two, ret > md AS above_median, round(10000 * (close / sp - 1), 4) AS since_bps FROM m JOIN f ON f.session = m.session AND f.leader = m.symbol WHERE bar_index > 5")
def rank_persistence(spark, d):
    return trajectories.rank_persistence(trajectories.opening_leaders(bars.hourly(spark, d), (5, 9, 15, 20)), 5)


