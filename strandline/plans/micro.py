"""Queries of quotes and trades: views are quotes, clicks are trades, users are symbols; a day is the unit of windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import micro
from strandline.plans.registry import H, query, table
from strandline.sources import bars
from strandline.streaming import stream_bars as streams

DAY = 86400.0
E = "WITH e AS (SELECT user_id AS k, event_id AS id, epoch_us(ts) / 1e6 AS t, event_type, value FROM events), q AS (SELECT k, id, t, value AS bid, CASE WHEN id % 11 = 0 THEN value WHEN id % 13 = 0 THEN value * 0.9 ELSE value * 1.04 END AS ask, CAST(id % 7 AS DOUBLE) AS bs, CAST(k % 5 + 1 AS DOUBLE) AS \"as\" FROM e WHERE event_type = 'view'), tr AS (SELECT k, id, t, value AS price, CAST(id % 9 + 1 AS DOUBLE) AS size FROM e WHERE event_type = 'click'), qv AS (SELECT *, bid > 0 AND ask >= bid AS ok FROM q), qp AS (SELECT *, CASE WHEN ok THEN (bid + ask) / 2 END AS mid, CASE WHEN ok THEN ask - bid END AS spread, CASE WHEN ok THEN (bs - \"as\") / (bs + \"as\" + 1e-12) END AS imb, CASE WHEN ok THEN (ask * bs + bid * \"as\") / (bs + \"as\" + 1e-12) - (bid + ask) / 2 END AS edge FROM qv)"


def _events(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("id"), micro.seconds("ts").alias("t"), "event_type", "value")


def _quotes(spark, d):
    e = _events(spark, d).where("event_type = 'view'")
    v, i = F.col("value"), F.col("id")
    return e.select("k", "id", "t", v.alias("bid"), F.when(i % 11 == 0, v).when(i % 13 == 0, v * 0.9).otherwise(v * 1.04).alias("ask"), (i % 7).cast("double").alias("bid_size"), (F.col("k") % 5 + 1).cast("double").alias("ask_size"))


def _trades(spark, d):
    return _events(spark, d).where("event_type = 'click'").select("k", "id", "t", F.col("value").alias("price"), (F.col("id") % 9 + 1).cast("double").alias("size"))


@query(E + " SELECT id, round(mid, 6) AS mid, round(spread, 6) AS spread, round(spread / mid * 10000, 4) AS spread_bps, round(imb, 6) AS imbalance, round(edge, 6) AS edge, CASE WHEN ok THEN round(CASE WHEN spread / 2 > 1e-12 THEN greatest(least(edge / (spread / 2), 1), -1) ELSE 0 END, 6) END AS edge_fraction FROM qp")
def quote_primitives(spark, d):
    q = micro.quote_primitives(_quotes(spark, d))
    return q.select("id", *[F.round(c, 4 if c == "spread_bps" else 6).alias(c) for c in ("mid", "spread", "spread_bps", "imbalance", "edge", "edge_fraction")])


#: Windows of a quarter day, a day and three days that end at each user's Fridays at midnight.
WIN = ", pt AS (SELECT DISTINCT k, 1704412800 + w * 604800.0 AS we FROM e, range(0, 4) r(w)), wn AS (SELECT k, we, unnest([21600.0, 86400.0, 259200.0]) AS len FROM pt), ww AS (SELECT k, we, len, we - len AS ws FROM wn)"


def _windows(spark, d):
    points = _events(spark, d).select("k").distinct().withColumn("w", F.explode(F.array(*[F.lit(1704412800 + w * 604800.0) for w in range(4)])))
    return micro.standard_windows(points, "k", "w", (21600, 86400, 259200))


@query(E + WIN + " SELECT k, we AS w_end, len AS length, ws AS w_start FROM ww")
def sliding_windows(spark, d):
    return _windows(spark, d)


@query("WITH x AS (SELECT user_id AS k, epoch_us(ts) / 1e6 AS t, epoch_us(ts) / 1e6 + 30 AS en FROM events WHERE event_type = 'click'), w AS (SELECT k, t, en, unnest([{'n': 'T-15_T-10', 'a': t - 900, 'z': t - 600}, {'n': 'T-10_T-5', 'a': t - 600, 'z': t - 300}, {'n': 'T-5_T', 'a': t - 300, 'z': t}, {'n': 'T_entry', 'a': t, 'z': en}, {'n': 'entry_5', 'a': en, 'z': en + 300}, {'n': 'entry_10', 'a': en, 'z': en + 600}, {'n': 'entry_15', 'a': en, 'z': en + 900}, {'n': 'entry_30', 'a': en, 'z': en + 1800}]) AS s FROM x) SELECT k, round(t, 3) AS t, s.n AS name, round(s.a, 3) AS w_start, round(s.z, 3) AS w_end FROM w")
def episode_windows(spark, d):
    x = _trades(spark, d).select("k", "t", (F.col("t") + 30).alias("en"))
    return micro.episode_windows(x, "k", "t", "en").withColumns({c: F.round(c, 3) for c in ("t", "w_start", "w_end")})


FLOW = E + WIN + """, pv AS (SELECT *, lag(bid) OVER o AS pb, lag(ask) OVER o AS pa, lag(bs) OVER o AS pbs, lag("as") OVER o AS pas, lag(spread) OVER o AS psp, lead(t) OVER o AS nx FROM qp WINDOW o AS (PARTITION BY k ORDER BY t, id)),
 hd AS (SELECT ww.k, we, len, ws, pv.* EXCLUDE (k), greatest(least(coalesce(nx, we), we) - t, 0) AS sp FROM ww JOIN pv ON pv.k = ww.k AND t >= ws AND t <= we),
 fl AS (SELECT k, we, len, ws, count(*) AS updates, count(*) FILTER (WHERE bid > pb) AS bid_up, count(*) FILTER (WHERE bid < pb) AS bid_down, count(*) FILTER (WHERE ask < pa) AS ask_up, count(*) FILTER (WHERE ask > pa) AS ask_down, count(*) FILTER (WHERE bid <> pb OR ask <> pa) AS price_updates, count(*) FILTER (WHERE bid = pb AND ask = pa AND (bs <> pbs OR "as" <> pas)) AS size_updates, count(*) FILTER (WHERE spread < psp) AS tighter, count(*) FILTER (WHERE spread > psp) AS wider, count(*) FILTER (WHERE bid = pb AND bs > pbs) AS bid_added, count(*) FILTER (WHERE bid = pb AND bs < pbs) AS bid_removed, count(*) FILTER (WHERE bid > ask) AS crossed, count(*) FILTER (WHERE bid = ask) AS locked,
 sum(imb * sp) AS wi, sum(edge * sp) AS we_, sum(CASE WHEN ok THEN sp END) AS ks, min(t) AS ft, arg_min(mid, t) FILTER (WHERE ok) AS fm, arg_max(mid, t) FILTER (WHERE ok) AS lm FROM hd GROUP BY 1, 2, 3, 4),
 st AS (SELECT ww.*, qp.mid AS am, qp.imb AS ai, qp.edge AS ae FROM ww ASOF LEFT JOIN qp ON ww.k = qp.k AND ww.ws >= qp.t),
 j AS (SELECT st.*, fl.* EXCLUDE (k, we, len, ws), CASE WHEN am IS NOT NULL THEN least(coalesce(ft, st.we), st.we) - st.ws ELSE 0 END AS bf FROM st LEFT JOIN fl ON fl.k = st.k AND fl.we = st.we AND fl.len = st.len)"""
COUNTS = "updates bid_up bid_down ask_up ask_down price_updates size_updates tighter wider bid_added bid_removed crossed locked".split()


@query(FLOW + " SELECT k, we AS w_end, len AS length, ws AS w_start, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in COUNTS) + ", round(CASE WHEN coalesce(ks, 0) + bf > 0 THEN (coalesce(wi, 0) + coalesce(ai * bf, 0)) / (coalesce(ks, 0) + bf) END, 5) AS mean_imbalance, round(CASE WHEN coalesce(ks, 0) + bf > 0 THEN (coalesce(we_, 0) + coalesce(ae * bf, 0)) / (coalesce(ks, 0) + bf) END, 5) AS mean_edge, round(lm - coalesce(am, fm), 6) AS mid_change, round(am, 6) AS start_mid FROM j")
def quote_flow(spark, d):
    return micro.quote_flow(_quotes(spark, d), _windows(spark, d), "k", ["id"], DAY)


SIDED = ", sd AS (SELECT tr.*, qv.bid AS ab, qv.ask AS aa, qv.bs AS abs_, qv.t AS at, CASE WHEN NOT coalesce(qv.ok, false) OR tr.t - qv.t > 172800 THEN 'UNCLASSIFIED' WHEN qv.ask <= qv.bid THEN 'UNKNOWN' WHEN price >= qv.ask THEN 'BUY' WHEN price <= qv.bid THEN 'SELL' ELSE 'UNKNOWN' END AS side FROM tr ASOF LEFT JOIN qv ON tr.k = qv.k AND tr.t > qv.t)"


def _sided(spark, d):
    return micro.sided_trades(_trades(spark, d), _quotes(spark, d), "k", ["id"], 172800.0)


@query(E + SIDED + " SELECT id, side FROM sd")
def probable_sides(spark, d):
    return _sided(spark, d).select("id", "side")


TF = E + WIN + SIDED + ", tw AS (SELECT ww.k, we, len, ws, count(*) AS trades, count(*) FILTER (WHERE side = 'BUY') AS buys, count(*) FILTER (WHERE side = 'SELL') AS sells, coalesce(sum(size) FILTER (WHERE side = 'BUY'), 0) AS buy, coalesce(sum(size) FILTER (WHERE side = 'SELL'), 0) AS sell, sum(size) AS al, avg(size) AS ms, median(size) AS md FROM ww JOIN sd ON sd.k = ww.k AND t >= ws AND t <= we GROUP BY 1, 2, 3, 4)"


@query(TF + " SELECT k, we AS w_end, len AS length, ws AS w_start, trades, buys, sells, buy, sell, round(al - buy - sell, 6) AS unknown, round((buy + sell) / (al + 1e-12), 6) AS valid_fraction, round(CASE WHEN (buy + sell) / (al + 1e-12) >= 0.5 AND buy + sell > 0 THEN (buy - sell) / (buy + sell + 1e-12) END, 6) AS imbalance, round(ms, 6) AS mean_size, round(md, 6) AS median_size FROM tw")
def trade_flow(spark, d):
    return micro.trade_flow(_sided(spark, d), _windows(spark, d), "k", DAY, 0.5)


MS = FLOW + SIDED + ", tw AS (SELECT ww.k, we, len, ws, count(*) FILTER (WHERE side = 'BUY') AS buys, coalesce(sum(size) FILTER (WHERE side = 'BUY'), 0) AS buy FROM ww JOIN sd ON sd.k = ww.k AND t >= ws AND t <= we GROUP BY 1, 2, 3, 4), im AS (SELECT j.k, j.we, j.len, round(lm - coalesce(am, fm), 6) AS ch, round(am, 6) AS sm, coalesce(buy, 0) AS buy, coalesce(buys, 0) AS buys FROM j LEFT JOIN tw ON tw.k = j.k AND tw.we = j.we AND tw.len = j.len)"


@query(MS + " SELECT k, we AS w_end, len AS length, round(ch, 6) AS signed, CASE WHEN buy > 0 AND buys > 0 AND ch IS NOT NULL THEN round(ch / (buy + 1e-12), 7) END AS per_share, CASE WHEN buy > 0 AND buys > 0 AND ch IS NOT NULL AND sm > 0 THEN round(ch / (buy * sm + 1e-12), 9) END AS per_notional, CASE WHEN buy > 0 AND buys > 0 AND ch IS NOT NULL AND sm > 0 THEN round(ch / sm * 10000, 4) END AS bps FROM im")
def price_impact(spark, d):
    w = _windows(spark, d)
    q = micro.quote_flow(_quotes(spark, d), w, "k", ["id"], DAY)
    t = micro.trade_flow(_sided(spark, d), w, "k", DAY, 0.5).select("k", "w_end", "length", "w_start", "buy", "buys")
    j = q.join(t, w.columns, "left").withColumns({"buy": F.coalesce("buy", F.lit(0.0)), "buys": F.coalesce("buys", F.lit(0))})
    return j.select("k", "w_end", "length", *[c.alias(n) for n, c in micro.impact("BUY", F.col("buy"), F.col("buys"), F.col("mid_change"), F.col("start_mid")).items()])


RP = E + SIDED + ", sl AS (SELECT k, id, t AS t0, ab, abs_ AS ss FROM sd WHERE side = 'SELL'), af AS (SELECT sl.k, sl.id, t0, ab, ss, qv.t, CASE WHEN bid >= ab THEN bs ELSE 0 END AS s, bid < ab AS gone FROM sl JOIN qv ON qv.k = sl.k AND qv.ok AND qv.t > t0 AND qv.t <= t0 + 345600), rs AS (SELECT k, id, t0, ss, list(s ORDER BY t) AS l, min(t) FILTER (WHERE gone) AS gt FROM af GROUP BY 1, 2, 3, 4), lw AS (SELECT *, least(list_min(l), ss) AS lo, list_slice(l, list_position(l, list_min(l)), len(l)) AS fw FROM rs)"


@query(RP + " SELECT k, id AS trade_id, round(greatest(ss - lo, 0), 6) AS depleted, round(greatest(list_max(fw) - lo, 0), 6) AS restored, round(coalesce(gt - t0, 345600), 3) AS survived FROM lw")
def replenishment(spark, d):
    q = _quotes(spark, d)
    from strandline.operators.joins import asof

    sided = _sided(spark, d).withColumnRenamed("id", "trade_id")
    size = asof(sided.select("k", "t", "trade_id", "side", "asof_bid"), q.select("k", "t", "bid_size"), ["k"], ["t"], ["bid_size"], strict=True).withColumnRenamed("asof_bid_size", "start_size").drop("asof_t")
    return micro.replenishment(size, q, "k", ["id"], 345600.0, 345600.0)


TB = "WITH s AS (SELECT event_type AS k, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS a, arg_min(value, ts) AS o, max(value) AS h, min(value) AS l, arg_max(value, ts) AS c, CASE WHEN min(value) >= 1 THEN count(*) END AS v, max(event_id) AS rc FROM events GROUP BY 1, 2), g AS (SELECT k, a // 86400 * 86400 AS start, count(*) AS subs, arg_min(o, a) AS open, max(h) AS high, min(l) AS low, arg_max(c, a) AS close, CASE WHEN count(v) = count(*) THEN CAST(sum(v) AS BIGINT) END AS volume, count(*) = 24 AS complete, max(a) AS ls, max(rc) AS rc FROM s GROUP BY 1, 2)"


def _subs(spark, d):
    e = table(spark, d, "events")
    a = F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    g = e.groupBy(F.col("event_type").alias("k"), a.alias("a")).agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.when(F.min("value") >= 1, F.count(F.lit(1))).alias("volume"), F.max("event_id").alias("rc"))
    # an older version of every sub-bar too, which must not count
    return g.unionByName(g.withColumns({"rc": F.col("rc") - 100000, "open": F.lit(None).cast("double"), "high": F.col("high") * 2}))


@query(TB + " SELECT k, start, subs, open, high, low, close, volume, complete, CASE WHEN complete THEN start + 86400 ELSE ls END AS as_of, greatest(CASE WHEN complete THEN start + 86400 ELSE ls END, rc) AS checkpoint FROM g")
def tumbling_bars(spark, d):
    return micro.tumbling(_subs(spark, d), "k", "a", "rc", 86400, 3600)


FI = "WITH u AS (SELECT o_orderpriority AS k, month(o_orderdate) + year(o_orderdate) * 100 AS bar, o_orderkey AS s, o_totalprice AS v FROM orders), f AS (SELECT *, max(bar) OVER (PARTITION BY k ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM u), l AS (SELECT *, coalesce(bar < far, false) AS late FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY k, bar ORDER BY late, s DESC) AS n, count(*) FILTER (WHERE late) OVER (PARTITION BY k, bar) AS late_updates, max(bar) OVER (PARTITION BY k) AS last FROM l)"


@query(FI + " SELECT k, bar, s, v, late_updates, bar < last AS final FROM r WHERE n = 1 AND NOT late")
def finalised_bars(spark, d):
    u = table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), (F.month("o_orderdate") + F.year("o_orderdate") * 100).cast("long").alias("bar"), F.col("o_orderkey").alias("s"), F.col("o_totalprice").alias("v"))
    return micro.finalised(u, "k", "bar", ["s"])


@query("SELECT o_custkey, o_orderstatus, count(*) AS emitted, count(DISTINCT o_orderpriority) AS versions FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderpriority) > 1")
def changed_final_bars(spark, d):
    return micro.changed_finals(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderpriority"])


@query(H + ", l AS (SELECT symbol, session, bar_index, open, CASE WHEN volume >= 6 THEN high * 1.01 ELSE high END AS high, low, close FROM b WHERE bar_index <> 7), j AS (SELECT coalesce(b.symbol, l.symbol) AS symbol, b.symbol AS x, l.symbol AS y, abs(b.high - l.high) > 0.5 AS off FROM (SELECT * FROM b WHERE bar_index <> 3) b FULL JOIN l ON b.symbol = l.symbol AND b.session = l.session AND b.bar_index = l.bar_index) SELECT symbol, count(*) FILTER (WHERE y IS NULL) AS only_research, count(*) FILTER (WHERE x IS NULL) AS only_live, count(*) FILTER (WHERE off) AS different, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS \"both\" FROM j GROUP BY 1")
def bar_semantics(spark, d):
    b = bars.hourly(spark, d)
    live = b.where("bar_index <> 7").withColumn("high", F.when(F.col("volume") >= 6, F.col("high") * 1.01).otherwise(F.col("high")))
    return micro.compare_bars(b.where("bar_index <> 3"), live, ["symbol", "session", "bar_index"], ["symbol"], 0.5)


IB = "WITH c AS (SELECT l_suppkey AS req, l_orderkey AS o, l_partkey AS p, l_linenumber AS n, l_shipdate AS r FROM lineitem), h AS (SELECT *, sha256(concat_ws('|', req, o, p)) AS content_id FROM c), f AS (SELECT content_id, any_value(req) AS req, any_value(o) AS o, min(r) AS r, count(*) AS copies FROM h GROUP BY 1), s AS (SELECT f.*, CASE WHEN s_acctbal < 0 AND r >= TIMESTAMP '1998-01-01' THEN 'expected_late' WHEN s_nationkey < 20 THEN 'accepted' ELSE 'quarantined' END AS status FROM f JOIN supplier ON s_suppkey = req)"


def _inbox(spark, d):
    l, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    c = l.select(F.col("l_suppkey").alias("req"), F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.col("l_shipdate").alias("r"))
    owners = s.where("s_nationkey < 20").select(F.col("s_suppkey").alias("req"))
    gone = s.where("s_acctbal < 0").select(F.col("s_suppkey").alias("req"), F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")).alias("cancelled"))
    return micro.admit(c, owners, gone, "req", ["req", "o", "p"], "r")


@query(IB + " SELECT content_id, req, copies, r, status FROM s")
def inbox_admit(spark, d):
    return _inbox(spark, d).select("content_id", "req", "copies", "r", "status")


@query(IB + ", op AS (SELECT * FROM s WHERE status = 'accepted' AND content_id >= '8'), pb AS (SELECT o, min(r) AS a, count(*) AS n FROM op GROUP BY 1), tk AS (SELECT o, coalesce(sum(n) OVER (ORDER BY a, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM pb) SELECT content_id, op.o FROM op JOIN tk USING (o) WHERE bf < 500")
def inbox_lease(spark, d):
    i = _inbox(spark, d)
    return micro.lease(i, i.where("content_id < '8'"), "content_id", "o", ["r"], 500).select("content_id", "o")


@query(IB + ", m AS (SELECT *, content_id < '8' AND r < TIMESTAMP '1997-01-01' AS cm FROM s) SELECT cm AS compacted, status IS NULL OR cm AS hidden, count(*) AS n, count(CASE WHEN NOT cm THEN req END) AS kept FROM m GROUP BY 1, 2")
def inbox_compaction(spark, d):
    i = _inbox(spark, d)
    c = micro.compacted(i, i.where("content_id < '8'"), "content_id", "r", F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00")))
    return c.groupBy("compacted", F.col("status").isNull().alias("hidden")).agg(F.count(F.lit(1)).alias("n"), F.count("req").alias("kept"))


@query(E + ", x AS (SELECT k, t AS a, lead(t) OVER (PARTITION BY k ORDER BY t) AS z FROM e) SELECT k, round(a, 3) AS gap_start, round(z, 3) AS gap_end, CASE WHEN z IS NULL THEN 'active' ELSE 'resolved' END AS status FROM x WHERE coalesce(z, 1706659200) - a > 86400")
def stream_gaps(spark, d):
    return micro.gaps(_events(spark, d), "k", "t", DAY, 1706659200.0)


@query(E + " SELECT id FROM e WHERE t > 1705276800 - 3600 * 12 AND t <= 1705276800")
def trimmed_history(spark, d):
    return micro.trimmed(_events(spark, d), "t", F.lit(1705276800.0), 43200.0).select("id")


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS events, sha256(string_agg(concat_ws('|', event_id, user_id, props), chr(10) ORDER BY ts, event_id)) AS digest FROM events GROUP BY 1, 2")
def replay_digest(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return micro.replay_digest(e, ["event_type", "day"], ["ts", "event_id"], ["event_id", "user_id", "props"])


@query("SELECT event_id FROM events ORDER BY ts, event_id")
def ordered_events(spark, d):
    return table(spark, d, "events").orderBy("ts", "event_id").select("event_id")


@query(H + " SELECT symbol, count(*) AS same, 0 AS only_batch, 0 AS only_stream FROM b GROUP BY 1")
def stream_parity(spark, d):
    b = ["symbol", "session", "bar_index", "open", "high", "low", "close", "volume"]
    return micro.parity(bars.hourly(spark, d).select(*b), streams.drained(spark, d).select(*b), ["symbol"], b)


@query("SELECT event_type AS symbol, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, count(DISTINCT user_id) AS users, count(*) AS n, round(sum(value), 4) AS volume FROM events GROUP BY 1, 2")
def stream_flow(spark, d):
    return streams.drained_flow(spark, d)


@query("SELECT CAST(0 AS BIGINT) AS late, count(*) AS kept FROM events")
def stream_late_rows(spark, d):
    return streams.drained_late(spark, d)
