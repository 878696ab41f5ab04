"""Queries of research runs over daily and hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.numbers import log
from strandline.functions.windows import enough, ordered, six, trailing
from strandline.operators import research
from strandline.plans.registry import D as PLAIN
from strandline.plans.registry import H, W, WD, query, table
from strandline.sources import bars

#: Daily bars with calmer prices: order totals move by factors, and compounded returns should stay numbers that can be compared.
D = PLAIN.replace("o_totalprice", "(300000 + o_totalprice / 10)")


def daily(spark, d):
    return bars.daily(spark, d).withColumns({c: 300000 + F.col(c) / 10 for c in ("open", "high", "low", "close")})


GRID = {"ps_0001": (3, 10), "ps_0002": (5, 20), "ps_0003": (10, 40), "ps_0004": (20, 60)}
#: Test windows of 60 rows after 250, five rows between.
SP = ", n AS (SELECT symbol, count(*) AS n FROM b GROUP BY 1), sp AS (SELECT symbol, printf('split_%03d', i + 1) AS split_id, i * 60 AS train_start, i * 60 + 250 AS train_end, i * 60 + 255 AS test_start, i * 60 + 315 AS test_end FROM n, range(0, 1000) t(i) WHERE i * 60 + 315 <= n)"


def scored(rows: str, keys: str, order: str, name: str = "e") -> str:
    """SQL: rows with gross, turnover and net inside each group."""
    w = f"OVER (PARTITION BY {keys} ORDER BY {order})"
    return f""", {name}0 AS (SELECT *, coalesce(close / lag(close) {w} - 1, 0) AS mv, coalesce(lag(position) {w}, 0) AS held FROM {rows}), {name} AS (SELECT *, held * mv AS gross, abs(position - held) AS turnover, held * mv - abs(position - held) * 5.0 / 10000 AS net FROM {name}0)"""


def measured(rows: str, keys: str, order: str, name: str = "m") -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    return f""", {name}1 AS (SELECT *, sum(ln(1 + net)) {w} AS eq FROM {rows}), {name}2 AS (SELECT *, exp(eq - max(eq) {w}) - 1 AS dd FROM {name}1), {name} AS (SELECT {keys}, exp(sum(ln(1 + gross))) - 1 AS gross_return, exp(sum(ln(1 + net))) - 1 AS net_return, sum(gross - net) AS costs, count(*) FILTER (WHERE turnover > 0) AS trades, avg(abs(position)) AS exposure, coalesce(avg(CASE WHEN turnover > 0 THEN CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END END), 0) AS win_rate, min(dd) AS max_drawdown FROM {name}2 GROUP BY {keys})"""


#: Measures as they are told: growth as its logarithm, which compares at any size.
TOLD = " SELECT * REPLACE (round(ln(1 + gross_return), 6) AS gross_return, round(ln(1 + net_return), 6) AS net_return, round(costs, 6) AS costs, round(exposure, 6) AS exposure, round(win_rate, 6) AS win_rate, round(max_drawdown, 6) AS max_drawdown) FROM m"


def told(m):
    return m.withColumns({c: six(log(1 + F.col(c))) for c in ("gross_return", "net_return")} | {c: six(F.col(c)) for c in ("costs", "exposure", "win_rate", "max_drawdown")})


def _splits(spark, d):
    return research.walk_forward_splits(daily(spark, d), "rolling", 250, 60, 60, 5)


def _mean(n):
    w = trailing(["symbol"], ["session"], n)
    return enough(F.round(F.avg("close").over(w), 6), F.count("close").over(w), n)


def _sma(fast, slow):
    return F.coalesce((_mean(fast) > _mean(slow)).cast("double"), F.lit(0.0))


def _positions(spark, d):
    return daily(spark, d).withColumn("position", _sma(5, 20))


def sma_sql(fast: int, slow: int) -> str:
    return f"CASE WHEN row_number() {WD}) >= {slow} AND round(avg(close) {WD} ROWS {fast - 1} PRECEDING), 6) > round(avg(close) {WD} ROWS {slow - 1} PRECEDING), 6) THEN 1.0 ELSE 0.0 END::DOUBLE"


P = D + f", p AS (SELECT symbol, session, close, {sma_sql(5, 20)} AS position FROM b)"


def split_sql(mode: str) -> str:
    start = "i * 40" if mode == "rolling" else "0"
    end = "i * 40 + 200" if mode != "fixed" else "200"
    return f"SELECT '{mode}' AS mode, symbol, printf('split_%03d', i + 1) AS split_id, CAST({start} AS INT) AS train_start, CAST({end} AS INT) AS train_end, CAST({end} + 10 AS INT) AS test_start, CAST({end} + 70 AS INT) AS test_end FROM n, range(0, {1 if mode == 'fixed' else 1000}) t(i) WHERE i * 40 + 270 <= n"


@query(D + ", n AS (SELECT symbol, count(*) AS n FROM b GROUP BY 1) " + " UNION ALL ".join(map(split_sql, ("rolling", "expanding", "fixed"))))
def walk_forward_modes(spark, d):
    b = daily(spark, d)
    parts = [research.walk_forward_splits(b, m, 200, 60, 40, 10).select(F.lit(m).alias("mode"), "*") for m in ("rolling", "expanding", "fixed")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT printf('ps_%04d', row_number() OVER (ORDER BY a.i, b.i, c.i)) AS parameter_set_id, a.v AS fast_window, b.v AS hold_bars, c.v AS side FROM (VALUES (1, 3), (2, 5)) a(i, v), (VALUES (1, 2), (2, 4), (3, 8)) b(i, v), (VALUES (1, 'long'), (2, 'short')) c(i, v)")
def parameter_grid(spark, d):
    return research.parameter_grid(spark, {"side": ["long", "short"], "fast_window": [3, 5], "hold_bars": [2, 4, 8]}).select("parameter_set_id", F.col("fast_window").cast("int"), F.col("hold_bars").cast("int"), "side")


PB = D + f", x AS (SELECT *, lag(close) {WD}) AS l, lag(close) {WD}) / lag(close, 2) {WD}) - 1 AS f FROM b), y AS (SELECT *, CASE WHEN count(l) {WD} ROWS 19 PRECEDING) >= 20 AND round(l - avg(l) {WD} ROWS 19 PRECEDING), 6) > 0 AND round(f, 9) <= -0.05 THEN 1.0 ELSE 0.0 END::DOUBLE AS e FROM x), p AS (SELECT symbol, session, close, max(e) {WD} ROWS 2 PRECEDING) AS position FROM y)"


@query(PB + " SELECT symbol, session, position FROM p")
def pullback_positions(spark, d):
    return research.pullback(daily(spark, d)).select("symbol", "session", "position")


@query(PB + f", s AS (SELECT symbol, session, greatest(least(position - coalesce(lag(position) {WD}), 0), 1), -1) AS signal FROM p) SELECT symbol, session, signal, signal > 0 AS entry, signal < 0 AS exit FROM s")
def template_signals(spark, d):
    return research.signals(research.pullback(daily(spark, d))).select("symbol", "session", "signal", "entry", "exit")


@query(P + scored("p", "symbol", "session") + measured("e", "symbol", "session") + TOLD)
def evaluate_positions(spark, d):
    return told(research.measures(research.scored(_positions(spark, d), ["symbol"], ["session"], 5.0), ["symbol"], ["session"]))


BASE = D + f", q AS (SELECT *, round(avg(close) {WD} ROWS 2 PRECEDING), 6) AS m FROM b), p AS (SELECT symbol, session, close, 'buy_and_hold' AS policy, 1.0::DOUBLE AS position FROM q UNION ALL SELECT symbol, session, close, 'always_flat', 0.0 FROM q UNION ALL SELECT symbol, session, close, 'random_entry_exit', CASE WHEN sha256(symbol || '|' || session)[1] IN ('0', '1', '2', '3', '4', '5', '6', '7') THEN 1.0 ELSE 0.0 END FROM q UNION ALL SELECT symbol, session, close, 'sma_momentum', CASE WHEN close > m THEN 1.0 ELSE 0.0 END FROM q UNION ALL SELECT symbol, session, close, 'mean_reversion', CASE WHEN close < m THEN 1.0 ELSE 0.0 END FROM q)"


@query(BASE + scored("p", "symbol, policy", "session") + measured("e", "symbol, policy", "session") + TOLD)
def baselines(spark, d):
    return told(research.baselines(daily(spark, d)))


NUMBERED = ", pn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session) - 1 AS rn FROM p)"
WIN = NUMBERED + ", w AS (SELECT pn.symbol, split_id, session, close, position FROM pn JOIN sp ON sp.symbol = pn.symbol AND rn >= test_start AND rn < test_end)"


@query(P + SP + WIN + scored("w", "symbol, split_id", "session") + measured("e", "symbol, split_id", "session") + TOLD)
def evaluation_windows(spark, d):
    return told(research.evaluated_windows(_positions(spark, d), _splits(spark, d)))


@query(P + SP + WIN + scored("w", "symbol, split_id", "session") + measured("e", "symbol, split_id", "session") + ", h AS (SELECT * REPLACE (1.0::DOUBLE AS position) FROM w)" + scored("h", "symbol, split_id", "session", "eh") + measured("eh", "symbol, split_id", "session", "mh") + ", a AS (SELECT symbol, count(*) AS windows, round(avg(net_return), 6) AS selected_net, round(avg(max_drawdown), 6) AS selected_drawdown FROM m GROUP BY 1), z AS (SELECT symbol, round(avg(net_return), 6) AS hold_net, round(avg(max_drawdown), 6) AS hold_drawdown FROM mh GROUP BY 1) SELECT *, round(selected_net - hold_net, 6) AS excess, selected_net > hold_net AS benchmark_pass FROM a JOIN z USING (symbol)")
def benchmark_comparison(spark, d):
    return research.against_benchmarks(_positions(spark, d), _splits(spark, d))


GP = D + ", g AS (" + " UNION ALL ".join(f"SELECT symbol, session, close, '{k}' AS parameter_set_id, {sma_sql(*v)} AS position FROM b" for k, v in GRID.items()) + ")" + SP + """, gn AS (SELECT *, row_number() OVER (PARTITION BY symbol, parameter_set_id ORDER BY session) - 1 AS rn FROM g), ss AS (SELECT symbol, split_id, 'train' AS side, train_start AS a, train_end AS z FROM sp UNION ALL SELECT symbol, split_id, 'test', test_start, test_end FROM sp), w AS (SELECT gn.symbol, parameter_set_id, side, split_id, session, close, position FROM gn JOIN ss ON ss.symbol = gn.symbol AND rn >= a AND rn < z)"""
GP += scored("w", "symbol, parameter_set_id, side, split_id", "session") + measured("e", "symbol, parameter_set_id, side, split_id", "session")
GP += ", gr AS (SELECT symbol, parameter_set_id, " + ", ".join(f"round(avg(net_return) FILTER (WHERE side = '{k}'), 6) AS {k}_net_return, round(avg(gross_return) FILTER (WHERE side = '{k}'), 6) AS {k}_gross_return, CAST(sum(trades) FILTER (WHERE side = '{k}') AS BIGINT) AS {k}_trade_count, round(min(max_drawdown) FILTER (WHERE side = '{k}'), 6) AS {k}_max_drawdown, round(avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE side = '{k}'), 6) AS {k}_profitable_split_pct, round(sum(costs) FILTER (WHERE side = '{k}'), 6) AS {k}_costs" for k in ("train", "test")) + " FROM m GROUP BY 1, 2)"


def _results(spark, d):
    return research.grid_results(daily(spark, d), _splits(spark, d), {k: _sma(*v) for k, v in GRID.items()})


@query(GP + " SELECT * FROM gr")
def param_grid_eval(spark, d):
    return _results(spark, d)


SEL = GP + ", gt AS (SELECT *, train_net_return > 0 AND train_trade_count >= 20 AND train_max_drawdown >= -0.25 AND train_profitable_split_pct >= 0.3 AS ok FROM gr), sl AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ok DESC, CASE WHEN ok THEN -train_net_return END, CASE WHEN ok THEN -train_profitable_split_pct END, CASE WHEN ok THEN -train_trade_count END, CASE WHEN ok THEN -train_max_drawdown END, parameter_set_id) AS k, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY symbol) AS BIGINT) AS pass_count, first_value(parameter_set_id) OVER (PARTITION BY symbol ORDER BY test_net_return DESC, parameter_set_id) AS best_test_id FROM gt), st AS (SELECT * EXCLUDE (ok, k), CASE WHEN ok THEN 'train_gated' ELSE 'fallback_for_reporting_only' END AS selection_method FROM sl WHERE k = 1)"


def _selected(spark, d):
    return research.select_parameters(_results(spark, d), 20, -0.25, 0.3)


@query(SEL + " SELECT * FROM st")
def train_gated_selection(spark, d):
    return _selected(spark, d)


STAB = SEL + ", sj AS (SELECT gr.symbol, st.parameter_set_id AS best, any_value(st.test_net_return) AS bt, any_value(st.train_net_return) AS br, round(median(gr.test_net_return), 6) AS median_test, coalesce(avg(CASE WHEN gr.parameter_set_id <> st.parameter_set_id THEN CASE WHEN gr.test_net_return > 0 THEN 1.0 ELSE 0.0 END END), 0) AS near FROM gr JOIN st USING (symbol) GROUP BY 1, 2), sb AS (SELECT symbol, best, median_test, round(near, 6) AS profitable_neighbours, round(br - bt, 6) AS degradation, round(greatest(least(0.6 * near + 0.4 * greatest(least(1 - greatest(br - bt, 0), 1), 0), 1), 0), 6) AS stability_score, near < 0.5 AS isolated FROM sj)"


@query(STAB + " SELECT * FROM sb")
def parameter_stability(spark, d):
    return research.stability(_results(spark, d), _selected(spark, d))


def offsets_sql(count: int = 7) -> str:
    """SQL: the seeded offsets of each symbol of nn (symbol, n)."""
    return f""", sd AS (SELECT symbol, n, CAST(('0x' || sha256('h1|' || upper(symbol) || '|1d|ps_0002')[1:16])::UBIGINT % CAST(n - 1 AS UBIGINT) AS BIGINT) + 1 AS step FROM nn WHERE n > 1),
 o1 AS (SELECT symbol, n, min(k) AS k, ((k * step - 1) % (n - 1)) + 1 AS o FROM sd, range(1, {count + 1}) t(k) WHERE k <= n - 1 GROUP BY symbol, n, o), o2 AS (SELECT symbol, n, 1000 + i AS k, i AS o FROM sd, range(1, {2 * count + 1}) t(i) WHERE i <= n - 1 ANTI JOIN o1 ON o1.symbol = sd.symbol AND o1.o = i),
 of AS (SELECT symbol, n, o FROM (SELECT * FROM o1 UNION ALL SELECT * FROM o2) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY k) <= {count})"""


NULLS = P + NUMBERED + ", nn AS (SELECT symbol, count(*) AS n FROM p GROUP BY 1)" + offsets_sql().replace("FROM sd, range(1, 15) t(i) WHERE i <= n - 1 ANTI JOIN o1 ON o1.symbol = sd.symbol AND o1.o = i", "FROM sd, range(1, 15) t(i) WHERE i <= n - 1 AND NOT EXISTS (SELECT 1 FROM o1 WHERE o1.symbol = sd.symbol AND o1.o = i)")
NULLS += ", mvd AS (SELECT pn.symbol, of.o AS offset, (rn + of.o) % n AS rn, position FROM pn JOIN of USING (symbol)), both_ AS (SELECT mvd.symbol, mvd.offset, mvd.rn, close, mvd.position FROM mvd JOIN pn ON pn.symbol = mvd.symbol AND pn.rn = mvd.rn)" + scored("both_", "symbol, \"offset\"", "rn", "ez") + ", nl AS (SELECT symbol, \"offset\", exp(sum(ln(1 + net))) - 1 AS net FROM ez GROUP BY 1, 2)" + scored("p", "symbol", "session") + ", own AS (SELECT symbol, exp(sum(ln(1 + net))) - 1 AS net FROM e GROUP BY 1), rk AS (SELECT symbol, list_sort(list(round(net, 9))) AS l, median(net) AS md FROM nl GROUP BY 1)"


@query(NULLS + " SELECT symbol, CAST(len(l) AS INT) AS count, round(net, 6) AS net, round(md, 6) AS median_null, round(l[CAST(greatest(ceil(len(l) * 0.75), 1) AS INT)], 6) AS p75_null, round(l[CAST(greatest(ceil(len(l) * 0.9), 1) AS INT)], 6) AS p90_null, round(net, 9) > l[CAST(greatest(ceil(len(l) * 0.75), 1) AS INT)] AS null_pass FROM own JOIN rk USING (symbol)")
def timing_null(spark, d):
    return research.timing_null(_positions(spark, d), F.concat(F.lit("h1|"), F.upper("symbol"), F.lit("|1d|ps_0002")))


LADDER = "CASE WHEN data_errors > 0 OR leakage_errors > 0 THEN 'rejected_data_issue' WHEN selection_rejected THEN 'rejected_no_edge' WHEN trade_count < 20 THEN 'rejected_too_few_trades' WHEN gross > 0 AND net <= 0 AND cost_drag > 0 THEN 'rejected_costs_kill_edge' WHEN net <= 0 OR NOT benchmark_pass OR NOT null_pass THEN 'rejected_no_edge' WHEN starts_with(holding, 'rejected_') THEN holding WHEN profitable_split_pct < 0.6 THEN 'rejected_walkforward_failure' WHEN stability_score < 0.5 THEN 'rejected_unstable_parameters' WHEN max_drawdown < -0.25 THEN 'interesting_needs_more_tests' WHEN holding IN ('interesting_swing_needs_more_tests', 'candidate_intraday_test') THEN holding ELSE 'candidate_paper_test' END"
RESULT = "WITH r AS (SELECT p_partkey, CAST(p_partkey % 37 = 0 AS INT) AS data_errors, CAST(p_partkey % 41 = 0 AS INT) AS leakage_errors, p_partkey % 29 = 0 AS selection_rejected, p_size + 10 AS trade_count, p_retailprice - 920 AS gross, p_retailprice - 950 AS net, 200.0 AS cost_drag, p_partkey % 7 <> 0 AS benchmark_pass, p_partkey % 11 <> 0 AS null_pass, CASE WHEN p_partkey % 13 = 0 THEN 'rejected_overnight_risk' WHEN p_partkey % 5 = 0 THEN 'candidate_intraday_test' END AS holding, (p_partkey % 10) / 10.0 AS profitable_split_pct, (p_partkey % 17) / 16.0 AS stability_score, -(p_partkey % 19) / 40.0 AS max_drawdown FROM part)"


@query(RESULT + f" SELECT p_partkey, {LADDER} AS classification FROM r")
def classification(spark, d):
    k = F.col("p_partkey")
    r = table(spark, d, "part").select(
        "p_partkey", (k % 37 == 0).cast("int").alias("data_errors"), (k % 41 == 0).cast("int").alias("leakage_errors"), (k % 29 == 0).alias("selection_rejected"), (F.col("p_size") + 10).alias("trade_count"), (F.col("p_retailprice") - 920).alias("gross"), (F.col("p_retailprice") - 950).alias("net"), F.lit(200.0).alias("cost_drag"),
        (k % 7 != 0).alias("benchmark_pass"), (k % 11 != 0).alias("null_pass"), F.when(k % 13 == 0, "rejected_overnight_risk").when(k % 5 == 0, "candidate_intraday_test").alias("holding"), (k % 10 / 10).alias("profitable_split_pct"), (k % 17 / 16).alias("stability_score"), (-(k % 19) / 40).alias("max_drawdown"),
    )
    return r.select("p_partkey", research.classification().alias("classification"))


#: Raw intraday positions: held while the close is above that of two bars before, over sessions.
RAW = H + """, p AS (SELECT *, CASE WHEN close > lag(close, 2) OVER (PARTITION BY symbol ORDER BY session, bar_index) THEN 1.0 ELSE 0.0 END::DOUBLE AS position, (max(bar_index) OVER (PARTITION BY symbol, session) - bar_index) * 60 AS tc FROM b)"""
FLAT = RAW + f""", x AS (SELECT *, position <> 0 AS "on", coalesce(lag(position <> 0) {W}), false) AS was FROM p), y AS (SELECT *, sum(CASE WHEN "on" AND NOT was THEN 1 ELSE 0 END) {W} ROWS UNBOUNDED PRECEDING) AS run, sum(CASE WHEN "on" THEN 0 ELSE 1 END) {W} ROWS UNBOUNDED PRECEDING) AS offs FROM x),
 z AS (SELECT symbol, session, arg_max("on", bar_index) AS l, arg_min("on", bar_index) AS f FROM x GROUP BY 1, 2), c AS (SELECT symbol, session, coalesce(lag(l) {WD}), false) AND f AS carried FROM z),
 k AS (SELECT y.*, carried AND "on" AND run = 1 AND offs = 0 AS cp, CASE WHEN "on" THEN max(tc) OVER (PARTITION BY y.symbol, y.session, run ORDER BY bar_index ROWS UNBOUNDED PRECEDING) END AS begun FROM y JOIN c USING (symbol, session)),
 fl AS (SELECT symbol, session, bar_index, open, close, position, cp AS carry_prevented, "on" AND NOT was AND NOT cp AND tc <= 180 AS late_entry, "on" AND NOT cp AND tc <= 60 AS forced_flat, CASE WHEN "on" AND NOT cp AND tc > 60 AND begun > 180 THEN position ELSE 0.0 END::DOUBLE AS adjusted FROM k)"""


def _raw(spark, d):
    b = bars.hourly(spark, d)
    held = F.col("close") > F.lag("close", 2).over(ordered(["symbol"], ["session", "bar_index"]))
    return b.withColumn("position", F.coalesce(held.cast("double"), F.lit(0.0)))


def _flat(spark, d):
    from pyspark.sql import Window

    to_close = (F.max("bar_index").over(Window.partitionBy("symbol", "session")) - F.col("bar_index")) * 60
    return research.session_flat(_raw(spark, d), to_close, 60, 180)


@query(FLAT + " SELECT symbol, session, bar_index, position, adjusted, carry_prevented, late_entry, forced_flat FROM fl")
def session_flat_policy(spark, d):
    return _flat(spark, d).select("symbol", "session", "bar_index", "position", "adjusted", "carry_prevented", "late_entry", "forced_flat")


@query(FLAT + " SELECT symbol, round(avg(abs(position)), 6) AS raw_exposure, round(avg(abs(adjusted)), 6) AS adjusted_exposure, count(*) FILTER (WHERE forced_flat) AS forced_flat, count(*) FILTER (WHERE late_entry) AS late_entries_blocked, count(DISTINCT session) AS sessions, count(DISTINCT CASE WHEN carry_prevented THEN session END) AS overnight_carry_prevented FROM fl GROUP BY 1")
def position_policy_effect(spark, d):
    return research.policy_effect(_flat(spark, d))


HOLD = RAW + """, a AS (SELECT *, CAST(session AS DATE) AS dy, position <> 0 AS h FROM p), q AS (SELECT *, lag(position) OVER s AS pp, lag(dy) OVER s AS pd, lag(close) OVER s AS pc, lag(h) OVER s AS ph FROM a WINDOW s AS (PARTITION BY symbol ORDER BY session, bar_index)), u AS (SELECT *, sum(CASE WHEN h <> ph THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY session, bar_index ROWS UNBOUNDED PRECEDING) AS run FROM q),
 rr AS (SELECT symbol, max(n) AS max_holding_bars, max(s) AS max_holding_sessions FROM (SELECT symbol, run, count(*) AS n, count(DISTINCT dy) AS s FROM u WHERE h GROUP BY 1, 2) GROUP BY 1), v AS (SELECT *, coalesce(pp <> 0, false) AS ca, dy <> pd AS nt, dy <> pd AND datediff('day', pd, dy) + isodow(pd) - 1 >= 5 AS we FROM u),
 hr AS (SELECT symbol, count(*) FILTER (WHERE ca AND nt) AS overnight, count(*) FILTER (WHERE ca AND we) AS weekend, round(coalesce(sum(pp * (open / pc - 1)) FILTER (WHERE ca AND nt), 0), 6) AS gap_return, round(coalesce(sum(pp * (open / pc - 1)) FILTER (WHERE ca AND we), 0), 6) AS weekend_return, round(coalesce(sum(pp * (close / pc - 1)) FILTER (WHERE ca AND NOT nt), 0), 6) AS intraday_return FROM v GROUP BY 1),
 hh AS (SELECT *, round(abs(gap_return) / (abs(gap_return) + abs(intraday_return)), 6) AS gap_share FROM hr JOIN rr USING (symbol))"""


@query(HOLD + " SELECT * FROM hh")
def holding_gap_attribution(spark, d):
    return research.holding_report(_raw(spark, d), F.to_date("session"))


@query(HOLD + " SELECT symbol, CASE WHEN overnight = 0 THEN 'candidate_intraday_test' WHEN weekend > 4 THEN 'rejected_weekend_risk' WHEN overnight > 14 OR gap_share > 0.6 THEN 'rejected_overnight_risk' WHEN max_holding_bars < 6 OR gap_share < 0.1 THEN 'interesting_swing_needs_more_tests' ELSE 'candidate_swing_exceptional' END AS decision FROM hh")
def holding_policy_decision(spark, d):
    h = research.holding_report(_raw(spark, d), F.to_date("session")).withColumns({"session_flat": F.col("overnight") == 0, "trade_count": F.col("max_holding_bars"), "excess": F.col("gap_share")})
    return h.select("symbol", research.holding_decision(14, 4, 0.6, True, True, 6, 0.1).alias("decision"))


@query("SELECT s_suppkey, CAST(2 * (s_suppkey % 5 + 1 + s_suppkey % 3) AS DOUBLE) AS round_trip FROM supplier")
def cost_model(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", research.round_trip_bps(k % 5, F.lit(1.0), k % 3).cast("double").alias("round_trip"))


