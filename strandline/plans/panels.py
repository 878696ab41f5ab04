"""Queries of panel joins and ordered samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.windows import six
from strandline.operators import events, panels
from strandline.plans.registry import EDGE_SQL, H, W, D, query, table
from strandline.sources import bars

SESSION = ["symbol", "session"]


@query("WITH f AS (SELECT c_nationkey AS n, c_mktsegment AS m, max(CASE WHEN c_acctbal > 9000 THEN 'active' ELSE 'inactive' END) AS s FROM customer WHERE c_nationkey < 20 GROUP BY 1, 2) SELECT c_custkey, coalesce(s, 'unknown') AS admission FROM customer LEFT JOIN f ON n = c_nationkey AND m = c_mktsegment")
def frozen_admission(spark, d):
    c = table(spark, d, "customer")
    f = c.where("c_nationkey < 20").groupBy("c_nationkey", "c_mktsegment").agg(F.max(F.when(F.col("c_acctbal") > 9000, "active").otherwise("inactive")).alias("state"), F.lit(1).alias("frozen"))
    return panels.frozen_admission(c.withColumn("decided", F.lit(2)), f, ["c_nationkey", "c_mktsegment"], "decided", "frozen").select("c_custkey", "admission")


@query(H + ", g AS (SELECT s.symbol, c.session FROM (SELECT DISTINCT symbol FROM b) s, (SELECT DISTINCT session FROM b) c), p AS (SELECT symbol, session, round(sum(close - open), 6) AS payoff FROM b WHERE high > 300 GROUP BY 1, 2) SELECT * FROM g LEFT JOIN p USING (symbol, session)")
def synchronized_panel(spark, d):
    b = bars.hourly(spark, d)
    grid = b.select("symbol").distinct().withColumn("one", F.lit(1)).join(F.broadcast(b.select("session").distinct().withColumn("one", F.lit(1))), "one").drop("one")
    p = b.where("high > 300").groupBy(*SESSION).agg(six(F.sum(F.col("close") - F.col("open"))).alias("payoff"))
    return panels.synchronized_panel(grid, p, SESSION)


@query(D + ", c AS (SELECT session, row_number() OVER (ORDER BY session) AS n FROM (SELECT DISTINCT session FROM b)), f AS (SELECT symbol, session, n, unnest([1, 5, 20]) AS lead FROM b JOIN c USING (session)) SELECT f.symbol, f.session, CAST(lead AS INT) AS lead, c.session AS target_session, o.close AS outcome FROM f LEFT JOIN c ON c.n = f.n + lead LEFT JOIN b o ON o.symbol = f.symbol AND o.session = c.session")
def lead_targets(spark, d):
    b = bars.daily(spark, d)
    return panels.lead_targets(b.select("symbol", "session"), b.select("symbol", "session", F.col("close").alias("outcome")), b, "symbol", "session", (1, 5, 20)).select("symbol", "session", "lead", "target_session", "outcome")


@query("WITH s AS (SELECT p_brand AS brand, p_partkey AS span_id, p_retailprice AS a, p_retailprice + 1.5 AS z FROM part), m AS (SELECT p.p_partkey AS k, count(span_id) AS n, min(span_id) AS s FROM part p LEFT JOIN s ON s.brand = p.p_brand AND a <= p.p_retailprice - 0.4 AND p.p_retailprice - 0.4 < z GROUP BY 1) SELECT k, n AS matches, CASE WHEN n = 0 THEN 'no_active_span' WHEN n > 1 THEN 'ambiguous_span' ELSE 'matched' END AS reason, CASE WHEN n = 1 THEN s END AS span_id FROM m")
def exact_active_pair(spark, d):
    p = table(spark, d, "part")
    points = p.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"), (F.col("p_retailprice") - 0.4).alias("t"))
    spans = p.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("span_id"), F.col("p_retailprice").alias("a"), (F.col("p_retailprice") + 1.5).alias("z"))
    return panels.exact_interval_match(points, spans, ["brand"], "t", "a", "z", 1.5, "k").select("k", "matches", "reason", "span_id")


PS = D + ", c AS (SELECT session, lag(session) OVER (ORDER BY session) AS required FROM (SELECT DISTINCT session FROM b)), f AS (SELECT symbol, session, volume FROM b WHERE volume >= 2), r AS (SELECT symbol, session, required FROM b JOIN c USING (session)), a AS (SELECT r.*, (SELECT max(f.session) FROM f WHERE f.symbol = r.symbol AND f.session < r.session) AS actual FROM r)"


@query(PS + " SELECT a.symbol, a.session, required, f.volume AS facts, CASE WHEN required IS NULL THEN 'no_previous_session' WHEN actual = required THEN 'exact' WHEN actual IS NULL THEN 'missing' ELSE 'stale' END AS status FROM a LEFT JOIN f ON f.symbol = a.symbol AND f.session = a.required")
def prior_day_join(spark, d):
    b = bars.daily(spark, d)
    f = b.where("volume >= 2").select("symbol", "session", F.col("volume").alias("facts"))
    return panels.previous_session(b.select("symbol", "session"), f, "symbol", "session", b).select("symbol", "session", "required", "facts", "status")


MR = "WITH t AS (SELECT c_custkey AS k, c_nationkey AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('7t|' || c_custkey)) AS i FROM customer WHERE c_acctbal < 500), p AS (SELECT c_custkey AS m, c_nationkey AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('7p|' || c_custkey)) AS i FROM customer WHERE c_acctbal >= 8000)"


@query(MR + " SELECT k, m AS match_k FROM t LEFT JOIN p ON t.n = p.n AND t.i = p.i")
def matched_random(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), "c_acctbal")
    return panels.matched_random(c.where("c_acctbal < 500"), c.where("c_acctbal >= 8000"), ["n"], "k", "7").select("k", "match_k")


@query("WITH w AS (SELECT c_nationkey AS n, count(*) AS c FROM customer WHERE c_acctbal < 0 GROUP BY 1) SELECT c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('9|' || c_custkey)) AS i FROM customer WHERE c_acctbal >= 0) JOIN w ON n = c_nationkey WHERE i <= c")
def pseudo_completions(spark, d):
    c = table(spark, d, "customer")
    return panels.pseudo_sample(c.where("c_acctbal < 0"), c, ["c_nationkey"], "c_custkey", "9").select("c_custkey")


NO = EDGE_SQL + ", k AS (SELECT *, symbol || session || bar_index AS id FROM e), j AS (SELECT x.id, y.id AS n, abs(y.bar_index - x.bar_index) AS dist, row_number() OVER (PARTITION BY x.id ORDER BY abs(y.bar_index - x.bar_index), y.bar_index, y.id) AS r FROM k x JOIN k y ON x.session = y.session AND x.symbol <> y.symbol)"


def _edges(spark, d):
    b = bars.hourly(spark, d)
    e = events.edge_events(b, F.col("close") > F.col("open"))
    return e.select(*SESSION, "bar_index").withColumn("id", F.concat("symbol", "session", F.col("bar_index").cast("string")))


@query(NO + " SELECT k.id, CAST(dist AS INT) AS distance FROM k LEFT JOIN j ON j.id = k.id AND r = 1")
def cross_symbol_nearest(spark, d):
    return panels.nearest_other(_edges(spark, d), ["session"], "bar_index", "symbol", "id").select("id", "distance")


AL = EDGE_SQL + f", r AS (SELECT symbol, session, bar_index, symbol || session || bar_index AS id, CASE WHEN close > 100 THEN 'h' ELSE 'l' END AS fam FROM e), c0 AS (SELECT symbol, session, bar_index, close, close > 120 AND NOT coalesce(lag(close > 120) {W}), false) AS g FROM b), c AS (SELECT symbol, session, bar_index, symbol || session || bar_index AS id, CASE WHEN close > 200 THEN 'h' ELSE 'l' END AS fam FROM c0 WHERE g), j AS (SELECT r.id, c.id AS cid, c.bar_index - r.bar_index AS sh, c.fam = r.fam AS sf, row_number() OVER (PARTITION BY r.id ORDER BY CASE WHEN c.fam <> r.fam THEN 1 ELSE 0 END, abs(c.bar_index - r.bar_index), c.bar_index, c.id) AS k FROM r JOIN c ON r.symbol = c.symbol AND r.session = c.session AND abs(c.bar_index - r.bar_index) <= 2)"


def _sides(spark, d):
    b = bars.hourly(spark, d)
    name = lambda e, limit: e.select(*SESSION, "bar_index", F.concat("symbol", "session", F.col("bar_index").cast("string")).alias("id"), F.when(F.col("close") > limit, "h").otherwise("l").alias("fam"))
    return name(events.edge_events(b, F.col("close") > F.col("open")), 100), name(events.edge_events(b, F.col("close") > 120), 200)


@query(AL + " SELECT r.id, cid AS candidate, CAST(sh AS INT) AS shift, sf AS same_family FROM r LEFT JOIN j ON j.id = r.id AND k = 1")
def aligned_events(spark, d):
    a, c = _sides(spark, d)
    return panels.align_events(a, c, SESSION, "bar_index", "fam", "id", 2).select("id", "candidate", "shift", "same_family")


@query(AL + " SELECT symbol, session, bar_index, CASE WHEN dd = 0 THEN 'exact' WHEN dd IS NOT NULL THEN 'bounded_shift' ELSE 'reference_only' END AS kind FROM (SELECT r.symbol, r.session, r.bar_index, min(abs(c.bar_index - r.bar_index)) AS dd FROM r LEFT JOIN c ON r.symbol = c.symbol AND r.session = c.session AND abs(c.bar_index - r.bar_index) <= 2 GROUP BY 1, 2, 3) UNION ALL SELECT symbol, session, bar_index, 'candidate_only' FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.symbol = c.symbol AND r.session = c.session AND abs(c.bar_index - r.bar_index) <= 2)")
def compared_events(spark, d):
    a, c = _sides(spark, d)
    return panels.compare_events(a, c, SESSION, "bar_index", 2)


@query(D + ", s AS (SELECT DISTINCT symbol, volume > 1 AS big, session FROM b), c AS (SELECT session, lead(session) OVER (ORDER BY session) AS nx FROM (SELECT DISTINCT session FROM b)), o AS (SELECT *, lead(session) OVER (PARTITION BY symbol, big ORDER BY session) AS own FROM s) SELECT symbol, big, session, CASE WHEN nx IS NULL THEN 'calendar_end' WHEN own = nx THEN 'next_session' WHEN own IS NOT NULL THEN 'later_session' ELSE 'never_again' END AS availability FROM o JOIN c USING (session)")
def next_session_setups(spark, d):
    b = bars.daily(spark, d)
    return panels.next_session_setups(b.select("symbol", "session", (F.col("volume") > 1).alias("big")), b, ["symbol", "big"], "session")


LC = "WITH a AS (SELECT l_linenumber AS l, avg(l_quantity) AS x, avg(l_discount) * 100 AS y FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), z AS (SELECT l_linenumber AS l, avg(l_quantity) AS x, avg(l_discount) * 100 AS y FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)"


@query(LC + " SELECT a.l AS a_label, z.l AS b_label, round((a.x - z.x) ** 2 + (a.y - z.y) ** 2, 6) AS cost FROM a, z")
def label_costs(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("l"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), "l_linestatus")
    return panels.label_costs(l.where("l_linestatus = 'O'"), l.where("l_linestatus = 'F'"), "l", ["x", "y"])


@query("SELECT CAST(0 AS INT) AS reference, CAST(0 AS INT) AS candidate UNION ALL SELECT 1, 2 UNION ALL SELECT 2, 1")
def aligned_labels(spark, d):
    return spark.createDataFrame(list(enumerate(panels.align_labels([[1.0, 5.0, 9.0], [4.0, 3.0, 1.0], [8.0, 1.0, 2.0]]))), "reference int, candidate int")


@query("WITH n AS (SELECT o_orderpriority AS f, o_orderkey AS t, o_totalprice AS v FROM orders WHERE o_orderstatus = 'P'), x AS (SELECT o_orderpriority AS f, o_orderkey AS t FROM orders WHERE o_orderstatus = 'F') SELECT x.f, x.t, n.t AS asof_t, n.v AS asof_v FROM x ASOF LEFT JOIN n ON x.f = n.f AND x.t > n.t")
def latest_nomination(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("f"), F.col("o_orderkey").alias("t"), F.col("o_totalprice").alias("v"), "o_orderstatus")
    return panels.latest_nomination(o.where("o_orderstatus = 'F'").select("f", "t"), o.where("o_orderstatus = 'P'"), "f", "t", "v")


@query("WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), j AS (SELECT a.vec_id AS q, z.vec_id AS n, list_cosine_similarity(a.e, z.e) AS s FROM v a JOIN v z ON a.label <> z.label WHERE a.vec_id % 50 = 0) SELECT q AS q_key, n AS nearest, round(s, 5) AS similarity FROM j QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, n) = 1")
def cosine_nearest(spark, d):
    # a search: its queries are the rows whose id is divisible by 50, against all rows
    return panels.cosine_nearest(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0, "vec_id", "embedding", "label")


@query("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS c FROM orders) SELECT o_orderkey FROM n WHERE i % greatest(1, c // 500) = 0")
def stride_sample(spark, d):
    return panels.stride(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 500).select("o_orderkey")


@query("WITH t AS (SELECT o_orderkey, month(o_orderdate) AS m, row_number() OVER (PARTITION BY month(o_orderdate) ORDER BY o_orderkey) AS turn FROM orders) SELECT o_orderkey, turn FROM t ORDER BY turn, m LIMIT 300")
def round_robin(spark, d):
    return panels.round_robin(table(spark, d, "orders").select("o_orderkey", F.month("o_orderdate").alias("m")), "m", ["o_orderkey"], 300).select("o_orderkey", "turn")


@query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('5|' || o_orderkey), o_orderkey) <= 50")
def training_sample(spark, d):
    return panels.training_sample(table(spark, d, "orders"), "o_orderpriority", ["o_orderkey"], "5", 50).select("o_orderkey")


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) <= 3")
def retained_candidates(spark, d):
    return panels.retained(table(spark, d, "part"), ["p_brand"], "p_size", "p_partkey", 3).select("p_brand", "p_partkey", "rank")
