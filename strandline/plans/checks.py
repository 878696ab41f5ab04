"""Queries of the checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.windows import ordered
from strandline.operators import backtest, checks
from strandline.plans.registry import H, W, WD, D, query, table
from strandline.sources import bars

SPLITS = D + ", n AS (SELECT symbol, count(*) AS n FROM b GROUP BY 1), s AS (SELECT symbol, CAST(i AS INT) AS split, CAST(i * 60 AS INT) AS train_start, CAST(i * 60 + 250 + i * 2 AS INT) AS train_end, CAST(i * 60 + 255 AS INT) AS test_start FROM n, range(0, 1000) t(i) WHERE i * 60 + 315 <= n)"


def _splits(spark, d):
    """Walk-forward splits whose training grows by two rows a split, so that it runs into the embargo, then into the test."""
    return backtest.splits(bars.daily(spark, d)).withColumn("train_end", F.col("train_end") + F.col("split") * 2)


@query("SELECT n_name, 'same_bar_close' AS code, 'error' AS severity, '' AS message FROM nation WHERE n_regionkey <= 2 AND n_nationkey - 12 <= 0")
def leakage_same_bar_close(spark, d):
    return checks.same_bar_close(table(spark, d, "nation"), ["n_name"], F.col("n_regionkey") <= 2, F.col("n_nationkey") - 12)


FT = "WITH m AS (SELECT p_partkey, list_distinct(string_split(lower(p_type || ' future_' || p_brand), ' ')) AS f, string_split(lower(p_name), ' ') AS t FROM part), x AS (SELECT p_partkey, array_to_string(list_sort(list_distinct(list_intersect(f, t))), ', ') AS b, array_to_string(list_sort(list_filter(f, lambda x: contains(x, 'future'))), ', ') AS l FROM m)"


@query(FT + " SELECT p_partkey, 'target_in_features' AS code, 'error' AS severity, b AS message FROM x WHERE b <> '' UNION ALL SELECT p_partkey, 'future_feature_name', 'warning', l FROM x WHERE l <> ''")
def leakage_feature_target_overlap(spark, d):
    p = table(spark, d, "part")
    m = p.select("p_partkey", F.array_distinct(F.split(F.lower(F.concat("p_type", F.lit(" future_"), "p_brand")), " ")).alias("f"), F.split(F.lower("p_name"), " ").alias("t"))
    return checks.feature_target_overlap(m, ["p_partkey"], "f", "t")


@query(SPLITS + " SELECT symbol, split, 'train_test_overlap' AS code, 'error' AS severity, '' AS message FROM s WHERE train_end > test_start")
def leakage_train_test_overlap(spark, d):
    return checks.train_test_overlap(_splits(spark, d), ["symbol", "split"])


@query(SPLITS + " SELECT symbol, split, 'embargo_violation' AS code, 'error' AS severity, concat(test_start - train_end, ' < 4') AS message FROM s WHERE test_start - train_end < 4")
def leakage_embargo(spark, d):
    return checks.embargo_violation(_splits(spark, d), ["symbol", "split"], 4)


TI = "WITH r AS (SELECT o_orderpriority AS symbol, o_orderdate AS t, lag(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) > o_orderdate AS back FROM orders), g AS (SELECT symbol, count(*) AS n, count(DISTINCT t) AS u, coalesce(bool_or(back), false) AS back FROM r GROUP BY 1), i AS (SELECT symbol, 'duplicate_timestamps' AS code, 'error' AS severity, '' AS message FROM g WHERE n > u UNION ALL SELECT symbol, 'non_monotonic_timestamps', 'error', '' FROM g WHERE back)"


def _arrivals(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("symbol"), "o_orderdate", "o_orderkey")


@query(TI + " SELECT * FROM i")
def leakage_timestamp_integrity(spark, d):
    return checks.timestamp_integrity(_arrivals(spark, d), ["symbol"], "o_orderdate", "o_orderkey")


RV = H + ", v AS (SELECT *, avg(volume) OVER w AS m, count(volume) OVER w AS n FROM b WINDOW w AS (PARTITION BY symbol, bar_index ORDER BY session ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING)), q AS (SELECT symbol, CASE WHEN n >= 15 THEN volume / m END AS signal FROM v)"


def _thin(spark, d):
    """A signal that needs fifteen sessions before it."""
    from strandline.operators import features

    return features.relative_volume(bars.hourly(spark, d), 15)


@query(RV + " SELECT symbol, 'nan_heavy_signal' AS code, 'error' AS severity, printf('%.3f', avg(CASE WHEN signal IS NULL THEN 1.0 ELSE 0.0 END)) AS message FROM q GROUP BY 1 HAVING avg(CASE WHEN signal IS NULL THEN 1.0 ELSE 0.0 END) > 0.25")
def leakage_signal_quality(spark, d):
    return checks.signal_quality(_thin(spark, d), ["symbol"], "relative_volume")


PP = H + f", r AS (SELECT symbol, close / open - 1 AS own, lead(close) {W}) / close - 1 AS target FROM b), q AS (SELECT symbol, CASE WHEN symbol = 'click' THEN 2 * target ELSE own END AS signal, target FROM r)"


@query(PP + " SELECT symbol, 'suspicious_perfect_prediction' AS code, 'warning' AS severity, '' AS message FROM q WHERE signal IS NOT NULL AND target IS NOT NULL GROUP BY 1 HAVING count(*) >= 3 AND abs(corr(signal, target)) >= 0.995")
def leakage_perfect_prediction(spark, d):
    b = bars.hourly(spark, d)
    target = F.lead("close").over(ordered(["symbol", "session"], ["bar_index"])) / F.col("close") - 1
    q = b.select("symbol", (F.col("close") / F.col("open") - 1).alias("own"), target.alias("target"))
    return checks.perfect_prediction(q.withColumn("signal", F.when(F.col("symbol") == "click", 2 * F.col("target")).otherwise(F.col("own"))), ["symbol"], "signal", "target")


@query("SELECT DISTINCT o_orderpriority, 'future_timestamp' AS code, 'error' AS severity, '' AS message FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 120 DAY")
def leakage_future_timestamps(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    j = o.join(l, o.o_orderkey == l.l_orderkey).select("o_orderpriority", "l_shipdate", (F.col("o_orderdate") + F.expr("INTERVAL 120 DAY")).alias("limit"))
    return checks.future_timestamps(j, ["o_orderpriority"], "l_shipdate", "limit")


@query(TI + f", b AS (SELECT o_orderpriority AS symbol, strftime(o_orderdate, '%Y-%m-%d') AS session FROM orders GROUP BY 1, 2), n AS (SELECT symbol, count(*) AS n FROM b GROUP BY 1), s AS (SELECT symbol, i * 60 + 250 + i * 2 AS train_end, i * 60 + 255 AS test_start FROM n, range(0, 1000) t(i) WHERE i * 60 + 315 <= n) SELECT * FROM i UNION SELECT symbol, 'train_test_overlap', 'error', '' FROM s WHERE train_end > test_start UNION SELECT symbol, 'embargo_violation', 'error', concat(test_start - train_end, ' < 4') FROM s WHERE test_start - train_end < 4")
def leakage_all(spark, d):
    s = _splits(spark, d)
    return checks.union(checks.timestamp_integrity(_arrivals(spark, d), ["symbol"], "o_orderdate", "o_orderkey"), checks.train_test_overlap(s, ["symbol"]), checks.embargo_violation(s, ["symbol"], 4))


@query("SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'brass') OR contains(lower(p_type), 'promo')")
def denied_features(spark, d):
    return checks.denied_features(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", ["brass", "promo"])


@query("SELECT event_type, max(ts) AS latest, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-29') AS rows_past FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-29') > 0")
def protected_boundary(spark, d):
    return checks.protected_boundary(table(spark, d, "events"), ["event_type"], "ts", F.to_timestamp_ntz(F.lit("2024-01-29 00:00:00")))


@query("WITH t AS (SELECT o_orderpriority AS symbol, CASE WHEN o_orderstatus = 'P' THEN 'not a time' WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '+00:00' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS t FROM orders) SELECT symbol, count(*) FILTER (WHERE t = 'not a time') AS invalid_timestamp, count(*) FILTER (WHERE t <> 'not a time' AND NOT ends_with(t, '+00:00')) AS timezone_naive, bool_and(ends_with(t, '+00:00')) AS all_aware FROM t GROUP BY 1")
def validate_timestamps(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    t = F.when(F.col("o_orderstatus") == "P", "not a time").when(F.col("o_orderstatus") == "F", F.concat(day, F.lit("+00:00"))).otherwise(day)
    return checks.unparsed_times(table(spark, d, "orders").select(F.col("o_orderpriority").alias("symbol"), t.alias("t")), ["symbol"], "t")


@query("SELECT symbol, o_orderkey FROM (SELECT o_orderpriority AS symbol, o_orderkey, lag(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) > o_orderdate AS back FROM orders) WHERE back")
def validate_order(spark, d):
    return checks.disordered(_arrivals(spark, d), ["symbol"], "o_orderdate", "o_orderkey").select("symbol", "o_orderkey")


VO = """WITH o AS (SELECT o_orderpriority AS symbol, o_orderdate AS t, o_totalprice AS open, o_totalprice * CASE WHEN o_orderstatus = 'P' THEN 0.99 ELSE 1.01 END AS high, o_totalprice * 0.98 AS low, o_totalprice AS close, CASE WHEN o_totalprice > 420000 THEN -1.0 WHEN o_totalprice < 120000 THEN 0.0 ELSE 1.0 END AS volume, o_orderkey FROM orders),
 z AS (SELECT *, row_number() OVER (PARTITION BY symbol, t ORDER BY o_orderkey) AS k FROM o), u AS (SELECT * FROM z WHERE k = 1),
 m AS (SELECT *, abs(close / lag(close) OVER w - 1) AS mv, volume = 0 AS q, row_number() OVER w AS n FROM u WINDOW w AS (PARTITION BY symbol ORDER BY t)), g AS (SELECT *, n - row_number() OVER (PARTITION BY symbol, q ORDER BY t) AS g FROM m),
 runs AS (SELECT symbol, g, count(*) AS n, min(t) AS a, max(t) AS z FROM g WHERE q GROUP BY 1, 2)"""


@query(VO + """ SELECT symbol, 'ohlc_inconsistent' AS code, 'error' AS severity, count(*) AS n, CAST(min(t) AS VARCHAR) AS first, CAST(max(t) AS VARCHAR) AS last FROM m WHERE high < greatest(open, close, low) OR low > least(open, close, high) GROUP BY 1
 UNION ALL SELECT symbol, 'negative_volume', 'error', count(*), CAST(min(t) AS VARCHAR), CAST(max(t) AS VARCHAR) FROM m WHERE volume < 0 GROUP BY 1 UNION ALL SELECT symbol, 'large_price_jump', 'warning', count(*), CAST(min(t) AS VARCHAR), CAST(max(t) AS VARCHAR) FROM m WHERE mv > 0.2 GROUP BY 1
 UNION ALL SELECT symbol, 'zero_volume_run', 'warning', max(n), CAST(min(a) AS VARCHAR), CAST(max(z) AS VARCHAR) FROM runs GROUP BY 1 HAVING max(n) >= 3""")
def validate_ohlcv(spark, d):
    o, p = table(spark, d, "orders"), F.col("o_totalprice")
    first = o.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("t")).agg(F.min_by(F.struct("o_totalprice", "o_orderstatus"), "o_orderkey").alias("r")).select("symbol", "t", "r.*")
    volume = F.when(p > 420000, -1.0).when(p < 120000, 0.0).otherwise(1.0)
    b = first.select("symbol", "t", p.alias("open"), (p * F.when(F.col("o_orderstatus") == "P", 0.99).otherwise(1.01)).alias("high"), (p * 0.98).alias("low"), p.alias("close"), volume.alias("volume"))
    return checks.validate_ohlcv(b, ["symbol"], "t")


CAL = D + ", x AS (SELECT min(CAST(session AS DATE)) AS a, max(CAST(session AS DATE)) AS z FROM b), c AS (SELECT strftime(x, '%Y-%m-%d') AS session FROM (SELECT unnest(generate_series(a, z, INTERVAL 1 DAY)) AS x FROM x) WHERE isodow(x) <= 5), s AS (SELECT symbol, min(session) AS a, max(session) AS z FROM b GROUP BY 1)"


@query(CAL + " SELECT s.symbol, c.session FROM s JOIN c ON c.session BETWEEN s.a AND s.z ANTI JOIN b ON b.symbol = s.symbol AND b.session = c.session")
def validate_calendar_gaps(spark, d):
    b = bars.daily(spark, d)
    return checks.missing_sessions(b, "symbol", "session", checks.weekdays(b, "session"))


@query(D + ", c AS (SELECT DISTINCT session FROM b), s AS (SELECT symbol, min(session) AS a, max(session) AS z FROM b GROUP BY 1) SELECT s.symbol, c.session FROM s JOIN c ON c.session BETWEEN s.a AND s.z ANTI JOIN b ON b.symbol = s.symbol AND b.session = c.session")
def validate_missing_sessions(spark, d):
    b = bars.daily(spark, d)
    return checks.missing_sessions(b, "symbol", "session", b.select("session").distinct())


SI = H + """, g AS (SELECT symbol, session, list_sort(list(bar_index)) AS h FROM b GROUP BY 1, 2), m AS (SELECT *, list_filter(range(1, 23), lambda x: NOT list_contains(h, x)) AS mi, list_filter(h, lambda x: x < 1 OR x > 22) AS ex, h[1] AS a, h[-1] AS z, session = min(session) OVER (PARTITION BY symbol) AS f, session = max(session) OVER (PARTITION BY symbol) AS l FROM g),
 r AS (SELECT symbol, session, CAST(len(h) AS INT) AS bars, CAST(len(mi) AS INT) AS missing_bars, CAST(len(ex) AS INT) AS extra_bars, list_contains(mi, 1) AS missing_open, len(list_filter(mi, lambda x: x > a AND x < z)) > 0 AS missing_middle, list_contains(mi, 22) AS missing_close, CASE WHEN a = 1 AND z = 22 THEN 'boundary_inclusive' WHEN a = 1 AND z = 21 THEN 'bar_open' WHEN a = 2 AND z = 22 THEN 'bar_close' ELSE 'partial_or_mixed' END AS convention, f, l FROM m),
 k AS (SELECT *, CASE WHEN extra_bars > 0 THEN 'session_calendar_mismatch' WHEN missing_bars = 0 THEN 'complete' WHEN (f OR l) AND missing_bars > 1 AND NOT missing_middle THEN 'expected_fetch_boundary_partial' WHEN missing_middle THEN 'possible_mid_session_gap' WHEN missing_open AND NOT missing_close THEN 'possible_missing_open_bar' WHEN missing_close AND NOT missing_open THEN 'possible_missing_close_bar' WHEN missing_open THEN 'possible_mid_session_gap' ELSE 'unknown' END AS bucket FROM r)"""


@query(SI + " SELECT * EXCLUDE (f, l), CASE WHEN bucket IN ('complete', 'expected_fetch_boundary_partial') THEN 'info' ELSE 'warning' END AS severity FROM k")
def session_integrity(spark, d):
    return checks.session_integrity(bars.hourly(spark, d), 1, 22)


@query("SELECT DISTINCT o_orderdate AS a, o_orderdate + INTERVAL 1 HOUR AS z, unnest(generate_series(o_orderdate, o_orderdate + INTERVAL 1 HOUR, INTERVAL 5 MINUTE)) AS timestamp FROM (SELECT DISTINCT o_orderdate FROM orders)")
def expected_session_times(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderdate").alias("a"), (F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("z")).distinct()
    return checks.expected_times(s, "a", "z", 5)


@query("WITH s AS (SELECT CASE WHEN p_size > 40 THEN lower(p_brand) ELSE p_brand || '.' || p_size END AS symbol, p_retailprice - 950 AS price, p_size - 2 AS vol FROM part) SELECT symbol, 'duplicate_symbol' AS code, 'error' AS severity, concat('appears ', count(*)) AS message FROM s GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT symbol, 'symbol_not_uppercase', 'error', '' FROM s WHERE symbol <> upper(symbol) UNION ALL SELECT symbol, 'non_positive_adjusted_close', 'warning', '' FROM s WHERE price <= 0 UNION ALL SELECT symbol, 'negative_avgvol', 'warning', '' FROM s WHERE vol < 0")
def validate_universe(spark, d):
    p = table(spark, d, "part")
    s = p.select(F.when(F.col("p_size") > 40, F.lower("p_brand")).otherwise(F.concat("p_brand", F.lit("."), "p_size")).alias("name"), (F.col("p_retailprice") - 950).alias("price"), (F.col("p_size") - 2).alias("vol"))
    return checks.validate_universe(s, "name", "price", "vol")


BA = "WITH e AS (SELECT event_id, value, event_type, CAST(user_id AS DOUBLE) AS age FROM events) SELECT event_id, CASE WHEN event_type = 'view' THEN 'partial_bar' WHEN event_type = 'login' THEN 'non_five_minute_bar' WHEN value > 400 THEN 'outside_frozen_regular_session' WHEN value < 1 THEN 'missing_required_bar_value' WHEN age > 140 THEN 'callback_received_after_scoring_checkpoint' WHEN 140 - age > 130 THEN 'stale_feature' WHEN event_type = 'signup' THEN 'blocked_feature_source_semantics_mismatch' WHEN value * 1.05 < value + 3 THEN 'invalid_ohlc' END AS reason FROM e"


@query(BA)
def bar_assessment(spark, d):
    v = F.col("value")
    b = table(spark, d, "events").select(
        "event_id", (F.col("event_type") != "view").alias("complete"), F.when(F.col("event_type") == "login", 6).otherwise(5).alias("minutes"), (v <= 400).alias("regular"), F.when(v >= 1, v).alias("open"), (v * 1.05).alias("high"), (v * 0.9).alias("low"), (v + 3).alias("close"), F.lit(1.0).alias("activity"),
        F.col("user_id").cast("double").alias("received"), F.lit(0.0).alias("source"), F.col("user_id").cast("double").alias("as_of"), F.lit(140.0).alias("checkpoint"), F.col("event_type"),
    )
    return b.select("event_id", checks.bar_rejection(F.lit(130.0), F.col("event_type") != "signup").alias("reason"))


@query("WITH q AS (SELECT p_partkey, CASE WHEN p_size = 1 THEN NULL ELSE p_retailprice - p_size END AS bid, CASE WHEN p_size = 2 THEN NULL WHEN p_size < 5 THEN p_retailprice - 4 ELSE p_retailprice - 25 END AS ask, p_size AS age FROM part) SELECT p_partkey, concat_ws(',', CASE WHEN bid IS NULL THEN 'missing_bid' END, CASE WHEN ask IS NULL THEN 'missing_ask' END, CASE WHEN bid = 0 THEN 'zero_bid' END, CASE WHEN bid > ask THEN 'crossed_quote' END, CASE WHEN bid = ask THEN 'locked_quote' END, CASE WHEN age > 30 THEN 'stale_quote' END, CASE WHEN bid + ask > 0 AND ask - bid > 0.02 * (bid + ask) / 2 THEN 'spread_too_wide' END, CASE WHEN age < 3 THEN 'size_missing' END, CASE WHEN age > 45 THEN 'market_data_not_live' END) AS flags FROM q")
def quote_quality_flags(spark, d):
    p, s, r = table(spark, d, "part"), F.col("p_size"), F.col("p_retailprice")
    bid, ask = F.when(s != 1, r - s), F.when(s == 2, F.lit(None)).when(s < 5, r - 4).otherwise(r - 25)
    return p.select("p_partkey", F.array_join(checks.quote_flags(bid, ask, F.when(s >= 3, s), s, s, F.lit(30), s <= 45, 0.02), ",").alias("flags"))


@query(r"SELECT c_custkey, '[REDACTED]' AS api_token, regexp_replace(regexp_replace('password=' || c_name || ' by Bearer ' || c_mktsegment, '(?i)\b(api_?key|token|secret|password)(\s*[=:]\s*)\S+', '\1\2[REDACTED]', 'g'), '(?i)\b(bearer\s+)\S+', '\1[REDACTED]', 'g') AS note FROM customer")
def redact_values(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("api_token"), F.concat(F.lit("password="), "c_name", F.lit(" by Bearer "), "c_mktsegment").alias("note"))
    return checks.redact_value(c, ["api_token", "note"])
