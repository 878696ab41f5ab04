"""Queries of tests, resampling, nulls, filter searches and rule books over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.numbers import rounded
from strandline.operators import inference
from strandline.plans.registry import query, table

E = """WITH e AS (SELECT event_id AS id, user_id AS stock, strftime(ts, '%Y-%m-%d') AS session, event_type AS kind, CAST(hour(ts) AS INT) AS hour, round(sin(event_id * 1.7) * 100, 4) AS net,
 (event_id * 7919 % 1009) / 1009.0::DOUBLE AS p, (event_id * 104729 % 997) / 997.0::DOUBLE AS x, CASE WHEN sin(event_id * 1.7) + (event_id * 7919 % 1009) / 1009.0::DOUBLE > 0.5 THEN 1 ELSE 0 END AS y FROM events)"""


def frame(spark, d):
    i = F.col("event_id")
    wave = F.sin(i * 17 / 10)  # 1.7 is a decimal in the SQL: the product is exact
    p = (i * 7919 % 1009) / 1009
    return table(spark, d, "events").select(i.alias("id"), F.col("user_id").alias("stock"), F.date_format("ts", "yyyy-MM-dd").alias("session"), F.col("event_type").alias("kind"), F.hour("ts").alias("hour"), rounded(wave * 100, 4).alias("net"), p.alias("p"), ((i * 104729 % 997) / 997).alias("x"), F.when(wave + p > 0.5, 1).otherwise(0).alias("y"))


def draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})), 1, 12))::BIGINT"


U = "281474976710656.0::DOUBLE"


@query(E + f", s AS (SELECT kind, session, avg(net) AS m FROM e GROUP BY 1, 2), o AS (SELECT kind, max(m) AS o FROM s GROUP BY 1) SELECT s.kind, round((sum(CASE WHEN m * 1.5 >= o THEN 1 ELSE 0 END) + 1) / (count(*) + 1), 6) AS p FROM s JOIN o ON s.kind = o.kind GROUP BY 1")
def empirical_p(spark, d):
    s = frame(spark, d).groupBy("kind", "session").agg(F.avg("net").alias("m"))
    return inference.empirical_p(s.groupBy("kind").agg(F.max("m").alias("v")), s.select("kind", (F.col("m") * 1.5).alias("v")), ["kind"], "v")


@query(E + ", t AS (SELECT kind, session, round(avg(p) / 20, 6) AS p FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY kind) AS n FROM t WINDOW w AS (PARTITION BY kind ORDER BY p, session)) SELECT kind, session, p, round(least(max(p * (n - r + 1)) OVER (PARTITION BY kind ORDER BY r), 1.0), 6) AS adjusted FROM r")
def holm_adjust(spark, d):
    t = frame(spark, d).groupBy("kind", "session").agg(F.round(F.avg("p") / 20, 6).alias("p"))
    return inference.holm(t, "p", ["kind"])


@query(E + ", s AS (SELECT kind, session, avg(net) + 3 AS m FROM e GROUP BY 1, 2), g AS (SELECT kind, count(m) AS n, avg(m) AS m, stddev_samp(m) AS s FROM s GROUP BY 1), a AS (SELECT *, atan(m / (s / sqrt(n)) / sqrt(n - 1)) AS an, pi() / 400 AS h FROM g), w AS (SELECT *, list_sum(list_transform(range(400), lambda i: pow(cos(-pi() / 2 + (i + 0.5) * h), n - 2) * h)) AS whole, list_sum(list_transform(range(400), lambda i: pow(cos(an + (i + 0.5) * (pi() / 2 - an) / 400), n - 2) * (pi() / 2 - an) / 400)) AS above FROM a) SELECT kind, n, round(above / whole, 5) AS p FROM w")
def session_p_value(spark, d):
    s = frame(spark, d).groupBy("kind", "session").agg((F.avg("net") + 3).alias("m"))
    return inference.one_sided_p(s, ["kind"], "m")


def block_sql(by: str, value: str, resamples: int, block: int) -> str:
    """Draws of (by, session, value) rows named s: cell, draw, total, n."""
    return f"""c AS (SELECT {by} AS cell, list({value} ORDER BY session) AS v, count(*) AS n FROM s GROUP BY 1), i AS (SELECT cell, v, n, unnest(range({resamples})) AS draw FROM c), j AS (SELECT *, unnest(range(n)) AS i FROM i),
 k AS (SELECT cell, draw, n, v[({draw('cell', 'draw', f'i // {block}')} % n + i % {block}) % n + 1] AS x FROM j), d AS (SELECT cell, draw, any_value(n) AS n, sum(x) AS total FROM k GROUP BY 1, 2)"""


@query(E + ", s AS (SELECT kind, session, avg(net) AS m FROM e GROUP BY 1, 2), " + block_sql("kind", "m", 200, 5) + ", q AS (SELECT draw, sum(total) / sum(n) AS mean FROM d GROUP BY 1) SELECT (SELECT round(avg(m), 6) FROM s) AS observed, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM q")
def block_bootstrap(spark, d):
    return inference.block_bootstrap(frame(spark, d), ["kind"], "session", "net", 200, 5)


RB = E + ", s0 AS (SELECT kind, session, sum(net) AS t, CAST(count(*) AS DOUBLE) AS b FROM e GROUP BY 1, 2)"


@query(RB + ", s AS (SELECT kind, session, struct_pack(t := t, b := b) AS m FROM s0), " + block_sql("kind", "m", 200, 5).replace("sum(x) AS total", "sum(x.t) / sum(x.b) AS level") + ", q AS (SELECT cell AS kind, round(quantile_cont(level, 0.025), 6) AS low, round(quantile_cont(level, 0.975), 6) AS high FROM d GROUP BY 1) SELECT q.kind, (SELECT round(sum(t) / sum(b), 6) FROM s0 WHERE s0.kind = q.kind) AS level, low, high FROM q")
def break_even_bootstrap(spark, d):
    return inference.ratio_bootstrap(frame(spark, d).withColumn("one", F.lit(1)), ["kind"], "session", "net", "one", 200, 5)


@query(E + f", s AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT session FROM e)), d AS (SELECT n, i, unnest(range(20)) AS draw FROM s), h AS (SELECT draw, {draw(chr(39) + 'session' + chr(39), 'draw', 'i')} % n AS i FROM d) SELECT draw, session, count(*) AS times FROM h JOIN s ON s.i = h.i GROUP BY 1, 2")
def session_draws(spark, d):
    return inference.session_draws(frame(spark, d), "session", 20)


PB = f"a AS (SELECT *, row_number() OVER (PARTITION BY session, kind ORDER BY id) AS r FROM e), z AS (SELECT session, kind, p, x, row_number() OVER (PARTITION BY session, kind ORDER BY {draw('7', 'id')}, id) AS r FROM e)"


@query(E + f", {PB} SELECT a.id, a.session, a.kind, a.net, z.p, z.x FROM a JOIN z USING (session, kind, r)")
def permuted_bundle(spark, d):
    return inference.permuted(frame(spark, d), ["session", "kind"], "id", ["p", "x"], 7).select("id", "session", "kind", "net", "p", "x")


CS = f", t AS (SELECT kind, session, hour, max(net) AS net FROM e GROUP BY 1, 2, 3), s AS (SELECT kind, session, row_number() OVER (PARTITION BY kind ORDER BY session) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM (SELECT DISTINCT kind, session FROM t)), f AS (SELECT *, (i + CASE WHEN n > 1 THEN 1 + {draw('kind', '3')} % (n - 1) ELSE 0 END) % n AS j FROM s)"


@query(E + CS + " SELECT t.kind, t.session, t.hour, o.net FROM t JOIN f ON f.kind = t.kind AND f.session = t.session JOIN s ON s.kind = f.kind AND s.i = f.j LEFT JOIN t o ON o.kind = s.kind AND o.session = s.session AND o.hour = t.hour")
def shifted_sessions(spark, d):
    t = frame(spark, d).groupBy("kind", "session", "hour").agg(F.max("net").alias("net"))
    return inference.shifted_sessions(t, ["kind"], "session", "hour", ["net"], 3)


@query(E + f", t AS (SELECT id, kind, hour, net, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY kind, hour) AS n FROM e WINDOW w AS (PARTITION BY kind, hour ORDER BY id)), f AS (SELECT *, (({draw('kind', 'hour', '11', 'i // 4')} % CAST(ceil(n / 4) AS BIGINT)) * 4 + i % 4) % n AS j FROM t) SELECT f.id, f.kind, f.hour, t.net FROM f JOIN t ON t.kind = f.kind AND t.hour = f.hour AND t.i = f.j")
def phase_block_null(spark, d):
    e = frame(spark, d).select("id", "kind", "hour", "net")
    return inference.phase_block_null(e, ["kind"], "hour", "id", "net", 4, 11)


@query(E + f", t AS (SELECT kind, session, round(avg(net), 6) AS a, round(avg(x), 6) AS z FROM e GROUP BY 1, 2), g AS (SELECT kind, list(a ORDER BY session) AS a, list(z ORDER BY session) AS z, count(*) AS n FROM t GROUP BY 1 HAVING count(*) > 2), d AS (SELECT *, unnest(range(41)) AS draw FROM g), s AS (SELECT *, CASE WHEN draw = 0 THEN 0 ELSE 1 + {draw('kind', 'draw')} % (n - 1) END AS s FROM d), i AS (SELECT *, unnest(range(n)) AS i FROM s), v AS (SELECT kind, draw, round(sum(a[i + 1] * z[(i + s) % n + 1]) / any_value(n), 9) AS v FROM i GROUP BY 1, 2), o AS (SELECT *, max(CASE WHEN draw = 0 THEN v END) OVER (PARTITION BY kind) AS o FROM v) SELECT kind, round(any_value(o), 6) AS observed, round(sum(CASE WHEN v >= o THEN 1 ELSE 0 END) / 41, 6) AS p FROM o GROUP BY 1")
def pair_shift_null(spark, d):
    t = frame(spark, d).groupBy("kind", "session").agg(F.round(F.avg("net"), 6).alias("a"), F.round(F.avg("x"), 6).alias("z"))
    return inference.pair_shift_null(t, ["kind"], "session", "a", "z", 40)


PATHS = [[0, 1], [1, 1, 0], [2, 0, 1, 2], [9, 0]]


def states(spark, d):
    return frame(spark, d).select("kind", "session", "id", F.floor(F.col("x") * 3).cast("int").alias("state"))


@query(E + """, s AS (SELECT kind, session, id, CAST(floor(x * 3) AS INT) AS s0, lead(CAST(floor(x * 3) AS INT)) OVER w AS s1, lead(CAST(floor(x * 3) AS INT), 2) OVER w AS s2, lead(CAST(floor(x * 3) AS INT), 3) OVER w AS s3 FROM e WINDOW w AS (PARTITION BY kind, session ORDER BY id)),
 m AS (SELECT s0 AS a, s1 AS b, count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY s0) AS p FROM s WHERE s1 IS NOT NULL GROUP BY 1, 2),
 q AS (SELECT unnest([[0, 1], [1, 1, 0], [2, 0, 1, 2], [9, 0]]) AS path) SELECT path,
 CASE len(path) WHEN 2 THEN (SELECT count(*) FROM s WHERE s0 = path[1] AND s1 = path[2]) WHEN 3 THEN (SELECT count(*) FROM s WHERE s0 = path[1] AND s1 = path[2] AND s2 = path[3]) ELSE (SELECT count(*) FROM s WHERE s0 = path[1] AND s1 = path[2] AND s2 = path[3] AND s3 = path[4]) END AS count,
 round(CASE len(path) WHEN 2 THEN (SELECT count(*) FROM s WHERE s0 = path[1] AND s1 IS NOT NULL) WHEN 3 THEN (SELECT count(*) FROM s WHERE s0 = path[1] AND s2 IS NOT NULL) ELSE (SELECT count(*) FROM s WHERE s0 = path[1] AND s3 IS NOT NULL) END
 * coalesce((SELECT p FROM m WHERE a = path[1] AND b = path[2]), 0) * CASE WHEN len(path) > 2 THEN coalesce((SELECT p FROM m WHERE a = path[2] AND b = path[3]), 0) ELSE 1 END * CASE WHEN len(path) > 3 THEN coalesce((SELECT p FROM m WHERE a = path[3] AND b = path[4]), 0) ELSE 1 END, 6) AS expected FROM q""")
def path_counts(spark, d):
    c = spark.createDataFrame([(p,) for p in PATHS], "path array<int>")
    return inference.path_counts(states(spark, d), ["kind", "session"], "id", "state", c)


FIRST = {0: 0.5, 1: 0.3, 2: 0.2}
MOVES = {0: {0: 0.2, 1: 0.5, 2: 0.3}, 1: {0: 0.6, 1: 0.1, 2: 0.3}, 2: {0: 0.3, 1: 0.3, 2: 0.4}}


SIM = E + f""", n AS (SELECT kind, session, least(count(*), 30) AS n FROM e GROUP BY 1, 2), c AS (SELECT * FROM (VALUES (0, 0.2::DOUBLE, 0.7::DOUBLE), (1, 0.6::DOUBLE, 0.7::DOUBLE), (2, 0.3::DOUBLE, 0.6::DOUBLE)) AS c(s, c0, c1)),
 u AS (SELECT kind, session, n, draw, i, {draw('kind', 'session', 'draw', 'i')} / {U} AS u FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, unnest(range(3)) AS draw FROM n))),
 z AS (SELECT kind, session, draw, list_reduce(list(CASE WHEN i = 0 THEN [CASE WHEN u < 0.5 THEN 0 WHEN u < 0.8 THEN 1 ELSE 2 END * 1.0] ELSE [u] END ORDER BY i), lambda a, b: list_append(a, CASE a[-1] WHEN 0 THEN CASE WHEN b[1] < 0.2 THEN 0.0 WHEN b[1] < 0.7 THEN 1.0 ELSE 2.0 END WHEN 1 THEN CASE WHEN b[1] < 0.6 THEN 0.0 WHEN b[1] < 0.7 THEN 1.0 ELSE 2.0 END ELSE CASE WHEN b[1] < 0.3 THEN 0.0 WHEN b[1] < 0.6 THEN 1.0 ELSE 2.0 END END)) AS l FROM u GROUP BY 1, 2, 3)"""


@query(SIM + " SELECT draw, CAST(sum(len(list_filter(range(1, len(l) - 1), lambda i: l[i] = 0 AND l[i + 1] = 1 AND l[i + 2] = 0))) AS BIGINT) AS count FROM z GROUP BY 1")
def simulated_counts(spark, d):
    n = frame(spark, d).groupBy("kind", "session").agg(F.least(F.count(F.lit(1)), F.lit(30)).cast("int").alias("n"))
    return inference.simulated_counts(n, ["kind", "session"], "n", FIRST, MOVES, [0, 1, 0], 3)


RS = E + f", k AS (SELECT kind, id, net, sum(CASE WHEN x > 0.7 THEN 1 ELSE 0 END) OVER (PARTITION BY kind) AS n, x > 0.7 AS kept FROM e), d AS (SELECT *, unnest(range(10)) AS draw FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY kind, draw ORDER BY {draw('draw', 'id')}, id) AS r FROM d), q AS (SELECT kind, draw, median(net) AS m, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS g FROM r WHERE r <= n GROUP BY 1, 2)"


@query(RS + " SELECT o.*, z.random_median, z.random_win FROM (SELECT kind, count(*) AS kept, round(median(net), 6) AS median, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 6) AS win FROM k WHERE kept GROUP BY 1) o JOIN (SELECT kind, round(median(m), 6) AS random_median, round(median(g), 6) AS random_win FROM q GROUP BY 1) z ON o.kind = z.kind")
def random_same_count(spark, d):
    return inference.random_same_count(frame(spark, d), ["kind"], "id", F.col("x") > 0.7, "net", 10)


@query(E + " SELECT kind, count(*) FILTER (WHERE x > 0.6) AS kept, round(count(*) FILTER (WHERE x > 0.6 AND net <= 0) / nullif(count(*) FILTER (WHERE net <= 0), 0), 6) AS capture, round(count(*) FILTER (WHERE x > 0.6 AND net > 0) / nullif(count(*) FILTER (WHERE net > 0), 0), 6) AS false_block, round(median(net) - median(net) FILTER (WHERE x > 0.6), 6) AS improvement FROM e GROUP BY 1")
def blocker_quality(spark, d):
    return inference.blocker_quality(frame(spark, d), ["kind"], F.col("x") > 0.6, "net")


@query(E + ", a AS (SELECT *, net * CASE WHEN kind < 'm' THEN 1 ELSE -1 END AS al, x > 0.6 AS k FROM e) SELECT kind, count(*) AS n, count(*) FILTER (WHERE k) AS kept, round(median(net), 6) AS raw_before, round(median(net) FILTER (WHERE k), 6) AS raw_after, round(median(al), 6) AS aligned_before, round(median(al) FILTER (WHERE k), 6) AS aligned_after, round(avg(CASE WHEN al > 0 THEN 1 ELSE 0 END), 6) AS win_before, round(avg(CASE WHEN al > 0 THEN 1 ELSE 0 END) FILTER (WHERE k), 6) AS win_after, round(avg(CASE WHEN al < 0 THEN 1 ELSE 0 END) FILTER (WHERE k), 6) AS wrong_way FROM a GROUP BY 1")
def role_rows(spark, d):
    return inference.role_rows(frame(spark, d), ["kind"], F.col("x") > 0.6, "net", F.when(F.col("kind") < "m", 1).otherwise(-1))


TF = E + """, t AS (SELECT * FROM e WHERE session < '2024-01-21'), q AS (SELECT f, unnest([0.25, 0.5, 0.75]) AS q, unnest(c) AS c FROM (SELECT 'p' AS f, quantile_cont(p, [0.25, 0.5, 0.75]) AS c FROM t UNION ALL SELECT 'x', quantile_cont(x, [0.25, 0.5, 0.75]) FROM t)),
 s AS (SELECT q.f || ' ' || op || ' ' || CAST(CAST(q.q AS DOUBLE) AS VARCHAR) AS rule, q.f, q.c, op FROM q, (VALUES ('<='), ('>=')) AS o(op)), k AS (SELECT rule, t.id, t.net, CASE WHEN op = '<=' THEN (CASE WHEN f = 'p' THEN p ELSE x END) <= c ELSE (CASE WHEN f = 'p' THEN p ELSE x END) >= c END AS k FROM s, t),
 b AS (SELECT rule, count(*) FILTER (WHERE k) AS kept, round(avg(net) FILTER (WHERE k) - avg(net), 6) AS score, count(*) AS n FROM k GROUP BY 1), ok AS (SELECT * FROM b WHERE kept >= 0.2 * n), top AS (SELECT rule, row_number() OVER (ORDER BY score DESC, rule) AS r FROM ok QUALIFY r <= 3),
 z AS (SELECT '(' || a.rule || ') ' || w || ' (' || c.rule || ')' AS rule, CASE WHEN w = 'AND' THEN ka.k AND kc.k ELSE ka.k OR kc.k END AS k, ka.net FROM top a JOIN top c ON a.r < c.r CROSS JOIN (VALUES ('AND'), ('OR')) AS o(w) JOIN k ka ON ka.rule = a.rule JOIN k kc ON kc.rule = c.rule AND kc.id = ka.id),
 zb AS (SELECT rule, count(*) FILTER (WHERE k) AS kept, round(avg(net) FILTER (WHERE k) - avg(net), 6) AS score, count(*) AS n FROM z GROUP BY 1)"""


@query(TF + " SELECT rule, kept, score FROM ok UNION ALL SELECT rule, kept, score FROM zb WHERE kept >= 0.2 * n")
def threshold_filters(spark, d):
    return inference.threshold_filters(frame(spark, d), F.col("session") < "2024-01-21", ["p", "x"], "net", [0.25, 0.5, 0.75], 0.2, 3)


EQ = ", ".join(f"({', '.join(s)})" for s in (("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c"), ("a", "b", "c")))


@query(E + f", t AS (SELECT kind AS a, hour // 6 AS b, CAST(floor(x * 4) AS INT) AS c FROM e), g AS (SELECT a, b, c, count(*) AS support, GROUPING(a) AS ga, GROUPING(b) AS gb, GROUPING(c) AS gc FROM t GROUP BY GROUPING SETS ({EQ})) SELECT concat_ws(' and ', CASE WHEN ga = 0 THEN 'a == ' || a END, CASE WHEN gb = 0 THEN 'b == ' || b END, CASE WHEN gc = 0 THEN 'c == ' || c END) AS rule, CAST(3 - ga - gb - gc AS INT) AS conditions, support FROM g WHERE support >= 10")
def equality_rules(spark, d):
    t = frame(spark, d).select(F.col("kind").alias("a"), F.floor(F.col("hour") / 6).alias("b"), F.floor(F.col("x") * 4).cast("int").alias("c"))
    return inference.equality_rules(t, ["a", "b", "c"], 10)


@query()
def tree_leaves(spark, d):
    t = frame(spark, d).select(F.floor(F.col("x") * 8).alias("x"), F.floor(F.col("p") * 8).alias("p"), "y")
    return inference.tree_leaves(t, ["x", "p"], "y")


RULES = [{"name": "calm", "when": [("x", "<=", 0.3), ("net", ">", 0.0)]}, {"name": "late", "when": [("hour", ">=", 18)]}, {"name": "views", "when": [("kind", "==", "view")]}]


@query(E + ", r AS (SELECT id, list_filter([CASE WHEN x <= 0.3 AND net > 0 THEN 'calm' END, CASE WHEN hour >= 18 THEN 'late' END, CASE WHEN kind = 'view' THEN 'views' END], lambda v: v IS NOT NULL) AS l FROM e) SELECT id, unnest(CASE WHEN len(l) > 0 THEN l ELSE ['unmatched'] END) AS rule FROM r")
def fixed_rulebook(spark, d):
    return inference.apply_rulebook(frame(spark, d), ["id"], RULES)


@query(E + ", v AS (SELECT id, CASE WHEN x > 0.7 THEN 2 ELSE 0 END AS l, CASE WHEN p > 0.6 THEN 1 ELSE 0 END AS s, hour > 3 AS ok, net > -20 AS w FROM e) SELECT id, CASE WHEN ok AND w AND (l > 0) <> (s > 0) THEN CASE WHEN l > 0 THEN 'LONG' ELSE 'SHORT' END ELSE 'NEUTRAL' END AS state, CASE WHEN NOT ok THEN 'movement_permission_failed' WHEN l > 0 AND s > 0 THEN 'conflicting_votes' WHEN l = 0 AND s = 0 THEN 'no_directional_vote' WHEN NOT w THEN 'non_positive_conservative_value' ELSE 'supported_directional_vote' END AS reason FROM v")
def controller_decision(spark, d):
    c = inference.controller(F.when(F.col("x") > 0.7, 2).otherwise(0), F.when(F.col("p") > 0.6, 1).otherwise(0), F.col("hour") > 3, F.col("net") > -20)
    return frame(spark, d).select("id", c.alias("c")).select("id", "c.state", "c.reason")


@query(E + ", o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY stock, session, hour ORDER BY net DESC, id) = 1) SELECT id, CASE WHEN row_number() OVER (PARTITION BY stock, session ORDER BY hour) = 1 THEN 'trade' ELSE 'one_trade_per_symbol_session' END AS outcome FROM o")
def dedupe_trades(spark, d):
    return inference.dedupe_trades(frame(spark, d), "stock", "hour", "session", "net", "id").select("id", "outcome")


@query(E + ", t AS (SELECT *, session < '2024-01-16' AS tr FROM e), g AS (SELECT median(net) FILTER (WHERE tr) AS gm, avg(CASE WHEN net > 0 THEN 1 ELSE 0 END) FILTER (WHERE NOT tr) AS gu, avg(CASE WHEN net < 0 THEN 1 ELSE 0 END) FILTER (WHERE NOT tr) AS gd FROM t), s AS (SELECT kind, count(*) FILTER (WHERE tr) AS train, count(*) FILTER (WHERE NOT tr) AS test, median(net) FILTER (WHERE tr) AS m, median(net) FILTER (WHERE NOT tr) AS tm, avg(CASE WHEN net > 0 THEN 1 ELSE 0 END) FILTER (WHERE NOT tr) AS up, avg(CASE WHEN net < 0 THEN 1 ELSE 0 END) FILTER (WHERE NOT tr) AS dn FROM t GROUP BY 1) SELECT kind, train, test, round(m, 6) AS train_median, round(tm, 6) AS test_median, CAST(sign(m) AS INT) AS direction, round(CASE WHEN m > 0 THEN up WHEN m < 0 THEN dn END, 6) AS accuracy, round(CASE WHEN gm > 0 THEN gu WHEN gm < 0 THEN gd END, 6) AS generic_accuracy FROM s, g")
def out_of_sample_response(spark, d):
    return inference.out_of_sample(frame(spark, d), F.col("session") < "2024-01-16", "kind", "net")


@query(E + ", g AS (SELECT substr(session, 9, 2)::INT // 5 AS month, CAST((x >= 0.25)::INT + (x >= 0.5)::INT + (x >= 0.75)::INT AS INT) AS bin, count(*) AS n, sum(net) AS s FROM e GROUP BY 1, 2), w AS (SELECT *, coalesce(sum(n) OVER w, 0) AS pn, coalesce(sum(s) OVER w, 0) AS ps FROM g WINDOW w AS (PARTITION BY bin ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT month, CAST(sum(n) AS BIGINT) AS events, CAST(sum(CASE WHEN pn >= 20 AND ps > 0 THEN n ELSE 0 END) AS BIGINT) AS traded, round(sum(CASE WHEN pn >= 20 AND ps > 0 THEN s END), 6) AS net FROM w GROUP BY 1")
def monthly_walk_forward(spark, d):
    e = frame(spark, d).withColumn("month", F.floor(F.substring("session", 9, 2).cast("int") / 5).cast("int"))
    return inference.monthly_walk_forward(e, "month", "x", "net", [0.25, 0.5, 0.75], 20)


@query(E + f", {PB}, j AS (SELECT a.id, a.p AS p0, a.x AS x0, a.y, z.p AS p1, z.x AS x1 FROM a JOIN z USING (session, kind, r)) SELECT unnest(['level', 'place']) AS \"group\", round(unnest([avg(pow(1 / (1 + exp(-(2 * p1 - x0))) - y, 2)), avg(pow(1 / (1 + exp(-(2 * p0 - x1))) - y, 2))]) - avg(pow(1 / (1 + exp(-(2 * p0 - x0))) - y, 2)), 6) AS importance FROM j")
def grouped_importance(spark, d):
    score = 1 / (1 + F.exp(-(2 * F.col("p") - F.col("x"))))
    return inference.grouped_importance(frame(spark, d), ["session", "kind"], "id", {"level": ["p"], "place": ["x"]}, score, "y", 7)


FE = SIM + ", p AS (SELECT *, list_min(list_transform(list_filter(range(1, least(len(l), 12) - 1), lambda i: l[i] = 0 AND l[i + 1] = 1 AND l[i + 2] = 0), lambda i: i + 2)) AS a, list_min(list_transform(list_filter(range(1, least(len(l), 12) - 2), lambda i: l[i] = 2 AND l[i + 1] = 1 AND l[i + 2] = 0 AND l[i + 3] = 2), lambda i: i + 3)) AS b FROM z)"


@query(FE + " SELECT draw, CASE WHEN a IS NULL AND b IS NULL THEN 'none' WHEN b IS NULL OR a <= b THEN 'back' ELSE 'tour' END AS first, count(*) AS sessions FROM p GROUP BY 1, 2")
def simulated_first_events(spark, d):
    n = frame(spark, d).groupBy("kind", "session").agg(F.least(F.count(F.lit(1)), F.lit(30)).cast("int").alias("n"))
    return inference.simulated_first_events(n, ["kind", "session"], "n", FIRST, MOVES, {"back": [0, 1, 0], "tour": [2, 1, 0, 2]}, 12, 3)


@query(E + ", g AS (SELECT substr(session, 9, 2)::INT // 5 AS month, kind AS rule, count(*) AS n, sum(net) AS s FROM e GROUP BY 1, 2), k AS (SELECT m.month, r.rule, n, s FROM (SELECT DISTINCT month FROM g) m CROSS JOIN (SELECT DISTINCT rule FROM g) r LEFT JOIN g ON g.month = m.month AND g.rule = r.rule), w AS (SELECT *, coalesce(sum(n) OVER w, 0) AS pn, sum(s) OVER w AS ps FROM k WINDOW w AS (PARTITION BY rule ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), b AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY round(ps / pn, 9) DESC, rule) AS r FROM w WHERE pn >= 30) SELECT m.month, rule, CAST(coalesce(n, 0) AS BIGINT) AS trades, round(s, 6) AS net FROM (SELECT DISTINCT month FROM g) m LEFT JOIN b ON b.month = m.month AND r = 1")
def monthly_rule_choice(spark, d):
    e = frame(spark, d).withColumn("month", F.floor(F.substring("session", 9, 2).cast("int") / 5).cast("int")).withColumnRenamed("kind", "rule")
    return inference.monthly_rule_choice(e, "month", "rule", "net", 30)


@query(E + ", s AS (SELECT stock % 20 AS family, session, CASE WHEN max(x) > 0.95 THEN 'up' WHEN max(p) > 0.9 THEN 'down' ELSE 'none' END AS cause FROM e GROUP BY 1, 2) SELECT family, session, count(*) OVER w AS at_risk, round((coalesce(sum((cause = 'up')::INT) OVER w, 0) + 0.5::DOUBLE) / (count(*) OVER w + 1.5), 6) AS hazard_up, round((coalesce(sum((cause = 'down')::INT) OVER w, 0) + 0.5::DOUBLE) / (count(*) OVER w + 1.5), 6) AS hazard_down FROM s WINDOW w AS (PARTITION BY family ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def prequential_hazards(spark, d):
    s = frame(spark, d).groupBy((F.col("stock") % 20).alias("family"), "session").agg(F.when(F.max("x") > 0.95, "up").when(F.max("p") > 0.9, "down").otherwise("none").alias("cause"))
    return inference.prequential_hazards(s, ["family"], "session", "cause", ["up", "down"], 0.5)
