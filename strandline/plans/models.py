"""Queries of measures, shrinkage, small fits, state models and receipts over events."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandline.operators import models
from strandline.plans.inference import E, frame
from strandline.plans.registry import query


@query(E + ", r AS (SELECT kind, y, row_number() OVER (PARTITION BY kind ORDER BY p DESC, id) AS r, count(*) OVER (PARTITION BY kind) AS n, avg(y) OVER (PARTITION BY kind) AS base FROM e) SELECT kind, CAST(ceil(any_value(n) * 0.1) AS BIGINT) AS k, round(avg(y) - any_value(base), 6) AS lift FROM r WHERE r <= ceil(n * 0.1) GROUP BY 1")
def top_decile_lift(spark, d):
    return models.top_decile_lift(frame(spark, d), ["kind"], "p", "y", "id")


@query(E + ", c AS (SELECT kind, hour % 3 AS t, p + 0.1 AS w, x / (x + p + 1) AS a, p / (x + p + 1) AS b, 1 / (x + p + 1) AS c FROM e) SELECT kind, round(sum(w * (pow(a - (t = 0)::INT, 2) + pow(b - (t = 1)::INT, 2) + pow(c - (t = 2)::INT, 2))) / sum(w), 6) AS brier FROM c GROUP BY 1")
def multiclass_brier(spark, d):
    s = F.col("x") + F.col("p") + 1
    c = frame(spark, d).select("kind", (F.col("hour") % 3).alias("t"), (F.col("p") + 0.1).alias("w"), (F.col("x") / s).alias("a"), (F.col("p") / s).alias("b"), (1 / s).alias("c"))
    return models.multiclass_brier(c, ["kind"], "t", ["a", "b", "c"], "w")


@query(E + " SELECT kind, CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS probability, round(avg(y), 6) AS rate, round(avg(y) - avg(p), 6) AS gap FROM e GROUP BY 1, 2")
def calibration_table(spark, d):
    return models.calibration_table(frame(spark, d), ["kind"], "p", "y")


@query(E + ", c AS (SELECT kind, session < '2024-01-16' AS early, y, p, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM e) SELECT kind, early, count(*) AS n, round(avg(y), 6) AS base, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(-CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END), 6) AS log_loss, round(1 - avg(pow(p - y, 2)) / var_pop(y), 6) AS skill FROM c GROUP BY 1, 2")
def prediction_metrics(spark, d):
    return models.prediction_metrics(frame(spark, d).withColumn("early", F.col("session") < "2024-01-16"), ["kind", "early"], "p", "y")


@query(E + ", n AS (SELECT session, hour, count(*) AS n FROM e GROUP BY 1, 2), t AS (SELECT avg(n) AS m FROM n) SELECT id, m / n AS weight FROM e JOIN n USING (session, hour), t")
def slate_weights(spark, d):
    return models.slate_weights(frame(spark, d), ["session", "hour"]).select("id", "weight")


@query(E + ", m AS (SELECT substr(session, 9, 2)::INT // 5 AS month, count(*) AS n FROM e GROUP BY 1), f AS (SELECT month, n AS test_rows, row_number() OVER w - 2 AS fold, min(month) OVER () AS train_from, lag(month) OVER w AS train_to, sum(n) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS train_rows FROM m WINDOW w AS (ORDER BY month)) SELECT month, test_rows, CAST(fold AS INT) AS fold, train_from, train_to, CAST(train_rows AS BIGINT) AS train_rows FROM f WHERE fold > 0")
def month_folds(spark, d):
    return models.month_folds(frame(spark, d), F.floor(F.substring("session", 9, 2).cast("int") / 5).cast("int"), 2)


@query(E + ", g AS (SELECT substr(session, 9, 2)::INT // 5 AS month, kind, count(*) AS n, sum(y) AS y FROM e GROUP BY 1, 2), c AS (SELECT *, coalesce(sum(n) OVER w, 0) AS pn, coalesce(sum(y) OVER w, 0) AS py FROM g WINDOW w AS (PARTITION BY kind ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), a AS (SELECT month, row_number() OVER (ORDER BY month) AS i, sum(sum(n)) OVER v AS an, sum(sum(y)) OVER v AS ay FROM g GROUP BY 1 WINDOW v AS (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT c.month, kind, n, round((py + 20.0::DOUBLE * ay / an) / (pn + 20), 6) AS prediction, round(y / n, 6) AS rate FROM c JOIN a USING (month) WHERE i > 1")
def month_predictions(spark, d):
    e = frame(spark, d).withColumn("month", F.floor(F.substring("session", 9, 2).cast("int") / 5).cast("int"))
    return models.month_predictions(e, "month", "kind", "y", 20.0, 1)


@query(E + " SELECT stock, round(CASE WHEN count(*) FILTER (WHERE hour > 12) = 0 THEN 0.4 ELSE count(*) FILTER (WHERE hour > 12) / (count(*) FILTER (WHERE hour > 12) + 5.0::DOUBLE) * sum(CASE WHEN hour > 12 THEN y ELSE 0 END) / count(*) FILTER (WHERE hour > 12) + (1 - count(*) FILTER (WHERE hour > 12) / (count(*) FILTER (WHERE hour > 12) + 5.0::DOUBLE)) * 0.4 END, 6) AS rate FROM e GROUP BY 1")
def shrunk_rate(spark, d):
    g = frame(spark, d).groupBy("stock").agg(F.count_if(F.col("hour") > 12).alias("n"), F.sum(F.when(F.col("hour") > 12, F.col("y")).otherwise(0)).alias("h"))
    return g.select("stock", F.round(models.shrunk_rate(F.col("h"), F.col("n"), F.lit(0.4), 5.0), 6).alias("rate"))


@query(E + ", a AS (SELECT count(*) AS an, avg(y) AS gu, avg(net) AS gr, stddev_pop(net) AS sd FROM e), g AS (SELECT kind || hour AS identity, count(*) AS support, (sum(y) + 50 * any_value(gu)) / (count(*) + 50) AS u, (sum(net) + 50 * any_value(gr)) / (count(*) + 50) AS m, any_value(gu) AS gu, any_value(gr) AS gr, any_value(sd) AS sd FROM e, a GROUP BY 1) SELECT identity, support, round(u, 6) AS up, round(m, 6) AS mean, round(u - gu + 0.5 * (m - gr) / sd, 6) AS score, CASE WHEN support < 20 THEN 'neutral' WHEN u > gu AND m > gr THEN 'positive' WHEN u < gu AND m < gr THEN 'negative' ELSE 'neutral' END AS class FROM g UNION ALL SELECT '__GLOBAL__', an, round(gu, 6), round(gr, 6), 0.0, 'neutral' FROM a")
def orientation_map(spark, d):
    return models.orientation_map(frame(spark, d).withColumn("k", F.concat("kind", F.col("hour").cast("string"))), "k", "y", "net")


JS = E + ", c AS (SELECT id, [x / (x + p + 1), p / (x + p + 1), 1 / (x + p + 1)] AS a, [(1 - x) / (2 - x + 0.5), 1 / (2 - x + 0.5), 0.5 / (2 - x + 0.5)] AS b FROM e), h AS (SELECT id, a, b, -list_sum(list_transform(a, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)) AS ha, -list_sum(list_transform(b, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)) AS hb, -list_sum(list_transform([(a[1] + b[1]) / 2, (a[2] + b[2]) / 2, (a[3] + b[3]) / 2], lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)) AS hm FROM c)"


@query(JS + " SELECT id, round(ha, 6) AS entropy, round(sqrt(greatest(hm - (ha + hb) / 2, 0)), 6) AS distance FROM h")
def distribution_distance(spark, d):
    x, p = F.col("x"), F.col("p")
    a, b = [x, p, F.lit(1.0)], [1 - x, F.lit(1.0), F.lit(0.5)]
    return frame(spark, d).select("id", F.round(models.entropy([v / (x + p + 1) for v in a]), 6).alias("entropy"), F.round(models.jensen_shannon(a, b), 6).alias("distance"))


ES = E + """, g AS (SELECT kind AS source, CASE WHEN hour < 2 THEN 'retired' ELSE 'active' END AS event, CASE WHEN x < 0.25 THEN 'click' ELSE 'view' END AS destination, count(*) AS support, sum(y) AS activations FROM e GROUP BY 1, 2, 3),
 z AS (SELECT source, event, destination, source = destination AS same, CASE WHEN source = destination THEN 0 ELSE support END AS support, CASE WHEN source = destination THEN 0 ELSE activations END AS activations FROM g),
 q AS (SELECT *, activations + 1.0::DOUBLE AS a, support - activations + 9.0::DOUBLE AS b FROM z), m AS (SELECT *, a / (a + b) AS rate, a / (a + b) / 0.4 AS lift, CASE WHEN a > 1 AND b > 1 THEN (a - 1) / (a + b - 2) ELSE 0.5 END AS m FROM q),
 i AS (SELECT source, event, destination, i, exp((a - 1) * ln((i + 0.5) / 2000) + (b - 1) * ln(1 - (i + 0.5) / 2000) - (a - 1) * ln(m) - (b - 1) * ln(1 - m)) AS d FROM m, range(2000) AS r(i)),
 c AS (SELECT *, sum(d) OVER (PARTITION BY source, event, destination ORDER BY i) AS s, sum(d) OVER (PARTITION BY source, event, destination) AS t FROM i),
 l AS (SELECT source, event, destination, (count(*) FILTER (WHERE s < 0.025 * t) + 0.5) / 2000 AS low, (count(*) FILTER (WHERE s < 0.975 * t) + 0.5) / 2000 AS high FROM c GROUP BY 1, 2, 3)"""


@query(ES + " SELECT m.source, m.event, m.destination, CAST(support AS BIGINT) AS support, CAST(activations AS BIGINT) AS activations, round(rate, 6) AS rate, round(lift, 6) AS lift, round(exp(support / (support + 20.0::DOUBLE) * greatest(-1.5, least(1.5, ln(lift)))), 6) AS shrunk_lift, round(low, 5) AS low, round(high, 5) AS high, CASE WHEN same THEN 'same_family_excluded' WHEN support >= 10 THEN 'supported' ELSE 'unknown' END AS status FROM m JOIN l ON l.source = m.source AND l.event = m.event AND l.destination = m.destination")
def edge_summary(spark, d):
    g = frame(spark, d).groupBy(F.col("kind").alias("source"), F.when(F.col("hour") < 2, "retired").otherwise("active").alias("event"), F.when(F.col("x") < 0.25, "click").otherwise("view").alias("destination")).agg(F.count(F.lit(1)).alias("support"), F.sum("y").alias("activations"), F.lit(0.4).alias("base"))
    return models.edge_summary(g, "base")


LIMITS = {"sessions": 3, "stocks": 2, "sample": 5.0, "sd": 90.0, "ood": 0.97, "retired": 0.3, "reset": 0.8, "off": 0.7, "active": 0.4, "survive": 0.2}
EV = E + ", v AS (SELECT id, hour AS sessions, id % 11 AS stocks, p * 100 AS sample, abs(net) AS sd, x AS ood, net AS mean, p AS positive, x AS change, 1 - p AS off, net + 30 AS lower, x AS active, p AS survive, CASE WHEN kind = 'click' THEN 'active' WHEN kind = 'view' THEN 'decaying' ELSE 'unknown' END AS previous FROM e)"
EV += """, u AS (SELECT *, list_filter([CASE WHEN sessions < 3 THEN 'insufficient_sessions' END, CASE WHEN stocks < 2 THEN 'insufficient_stocks' END, CASE WHEN sample < 5 THEN 'insufficient_effective_sample_size' END, CASE WHEN sd > 90 THEN 'posterior_uncertainty_too_high' END, CASE WHEN ood > 0.97 THEN 'out_of_distribution' END], lambda z: z IS NOT NULL) AS un,
 previous <> 'unknown' AS held, CASE WHEN lower <= 0 THEN 'lower_bound_not_positive' END AS lb FROM v),
 s AS (SELECT *, CASE WHEN len(un) > 0 THEN 'unknown' WHEN mean <= 0 AND positive <= 0.3 OR held AND change >= 0.8 AND positive < 0.5 THEN 'retired' WHEN held AND (off >= 0.7 OR lower <= 0) THEN 'decaying' WHEN active < 0.4 OR lower <= 0 OR survive < 0.2 THEN 'not' ELSE 'active' END AS s FROM u)"""


@query(EV + " SELECT id, CASE WHEN s = 'not' THEN 'unknown' ELSE s END AS state, array_to_string(list_filter(CASE WHEN len(un) > 0 THEN un WHEN s = 'retired' THEN ['retired_state', 'edge_probability_too_low', lb] WHEN s = 'decaying' THEN ['decaying_state', CASE WHEN off >= 0.7 THEN 'termination_probability_too_high' END, lb] WHEN s = 'not' THEN [CASE WHEN active < 0.4 THEN 'edge_probability_too_low' END, lb, CASE WHEN survive < 0.2 THEN 'survival_probability_too_low' END] ELSE [] END, lambda z: z IS NOT NULL), ',') AS reasons FROM s")
def edge_state(spark, d):
    e = frame(spark, d)
    v = e.select("id", F.col("hour").alias("sessions"), (F.col("id") % 11).alias("stocks"), (F.col("p") * 100).alias("sample"), F.abs("net").alias("sd"), F.col("x").alias("ood"), F.col("net").alias("mean"), F.col("p").alias("positive"), F.col("x").alias("change"), (1 - F.col("p")).alias("off"), (F.col("net") + 30).alias("lower"), F.col("x").alias("active"), F.col("p").alias("survive"), F.when(F.col("kind") == "click", "active").when(F.col("kind") == "view", "decaying").otherwise("unknown").alias("previous"))
    return v.select("id", models.edge_state(LIMITS).alias("s")).select("id", "s.state", F.array_join("s.reasons", ",").alias("reasons"))


RG = E + ", l AS (SELECT kind, 'net' AS feature, CASE WHEN hour % 5 = 0 THEN NULL ELSE net END AS v, session FROM e UNION ALL SELECT kind, 'x', x, session FROM e UNION ALL SELECT kind, 'flat', CASE WHEN hour = 0 THEN x ELSE 1.0 END, session FROM e), f AS (SELECT * FROM l WHERE session < '2024-01-16'), m AS (SELECT kind, feature, median(v) AS m FROM f GROUP BY 1, 2), k AS (SELECT f.kind, f.feature, m, coalesce(v, m) AS v FROM f JOIN m ON m.kind = f.kind AND m.feature = f.feature), g AS (SELECT kind, feature, round(any_value(m), 6) AS median, round(CASE WHEN quantile_cont(v, 0.75) - quantile_cont(v, 0.25) > 1e-12 THEN quantile_cont(v, 0.75) - quantile_cont(v, 0.25) WHEN median(abs(v - m)) > 1e-12 THEN median(abs(v - m)) * 1.4826 ELSE 1.0 END, 6) AS scale FROM k GROUP BY 1, 2)"


def geometry(spark, d):
    e = frame(spark, d).withColumns({"net": F.when(F.col("hour") % 5 != 0, F.col("net")), "flat": F.when(F.col("hour") == 0, F.col("x")).otherwise(1.0)})
    return e, models.robust_geometry(e, ["kind"], ["net", "x", "flat"], F.col("session") < "2024-01-16")


@query(RG + " SELECT * FROM g")
def robust_geometry(spark, d):
    return geometry(spark, d)[1]


@query(RG + " SELECT e.id, round(coalesce(greatest(-3, least(3, (CASE WHEN e.hour % 5 = 0 THEN NULL ELSE net END - a.median) / a.scale)), 0), 6) AS net, round(greatest(-3, least(3, (e.x - z.median) / z.scale)), 6) AS x FROM e JOIN g a ON a.kind = e.kind AND a.feature = 'net' JOIN g z ON z.kind = e.kind AND z.feature = 'x'")
def stock_scaled(spark, d):
    e, g = geometry(spark, d)
    return models.scaled(e, ["kind"], g, ["net", "x", "flat"], 3.0).select("id", F.round("net", 6).alias("net"), F.round("x", 6).alias("x"))


@query(E + ", s AS (SELECT sum(w) AS w, sum(w * x) AS wx, sum(w * net) AS wy, sum(w * x * x) AS wxx, sum(w * x * net) AS wxy FROM (SELECT x, net, p + 0.1 AS w FROM e)), f AS (SELECT (wxy - wx * wy / w) / (wxx - wx * wx / w + 1.0) AS b, wx, wy, w FROM s) SELECT unnest(['intercept', 'x']) AS term, round(unnest([(wy - b * wx) / w, b]), 6) AS value FROM f")
def ridge_fit(spark, d):
    e = frame(spark, d)
    b = models.fit_ridge(e, ["x"], "net", F.col("p") + 0.1)
    return spark.createDataFrame(list(zip(["intercept", "x"], [round(v, 6) for v in b], strict=True)), "term string, value double")


@query()
def logistic_fit(spark, d):
    b = models.fit_logistic(frame(spark, d), ["p", "x"], "y", F.lit(1.0))
    return frame(spark, d).select("id", F.round(models.sigmoid(models.linear(b, ["p", "x"])), 6).alias("probability"))


@query()
def multinomial_fit(spark, d):
    e = frame(spark, d).withColumn("t", F.when(F.col("net") > 40, 2).when(F.col("p") > 0.5, 1).otherwise(0))
    b = models.fit_multinomial(e, ["p", "x"], "t", 3, F.lit(1.0))
    return e.select("id", *[F.round(v, 5).alias(f"p{k}") for k, v in enumerate(models.class_probabilities(b, ["p", "x"]))])


@query()
def mixture_fit(spark, d):
    m = models.fit_mixture(frame(spark, d), ["x", "p"], 4, steps=20)
    logs = models.log_emissions(["x", "p"], m["means"], m["variances"])
    return frame(spark, d).select("id", *[F.round(v, 5).alias(f"p{k}") for k, v in enumerate(models.posterior(logs, m["weights"]))])


@query()
def common_factor(spark, d):
    w = frame(spark, d).groupBy("session", "hour").pivot("kind", ["click", "purchase", "signup", "view"]).agg(F.avg("net"))
    shares = models.explained_variance(w, ["click", "purchase", "signup", "view"])
    return spark.createDataFrame([(i + 1, round(v, 6)) for i, v in enumerate(shares)], "component int, share double")


@query(E + " SELECT id, round(-0.5 * (ln(2 * pi() * 0.04) + pow(x - 0.2, 2) / 0.04) - 0.5 * (ln(2 * pi() * 0.09) + pow(p - 0.5, 2) / 0.09), 6) AS l0, round(-0.5 * (ln(2 * pi() * 0.05) + pow(x - 0.8, 2) / 0.05) - 0.5 * (ln(2 * pi() * 0.02) + pow(p - 0.1, 2) / 0.02), 6) AS l1 FROM e")
def gaussian_emissions(spark, d):
    l = models.log_emissions(["x", "p"], [[0.2, 0.5], [0.8, 0.1]], [[0.04, 0.09], [0.05, 0.02]])
    return frame(spark, d).select("id", F.round(l[0], 6).alias("l0"), F.round(l[1], 6).alias("l1"))


RUN = E + ", r AS (SELECT CAST(floor(x * 3) AS INT) AS state, 1 + id % 7 AS duration, CASE WHEN hour > 20 THEN 'session_end' ELSE 'exit' END AS ending FROM e), c AS (SELECT state, least(duration, 6) AS age, count(*) AS n, sum(CASE WHEN ending = 'exit' AND duration <= 6 THEN 1 ELSE 0 END) AS en FROM r GROUP BY 1, 2), k AS (SELECT s.state, a.age, coalesce(n, 0) AS n, coalesce(en, 0) AS en FROM (SELECT DISTINCT state FROM r) s CROSS JOIN range(1, 7) AS a(age) LEFT JOIN c ON c.state = s.state AND c.age = a.age), q AS (SELECT *, sum(n) OVER (PARTITION BY state ORDER BY age ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ar FROM k), hz AS (SELECT state, age, CAST(en AS BIGINT) AS ended, CAST(ar AS BIGINT) AS at_risk, round((en + 1.0::DOUBLE * sum(en) OVER (PARTITION BY state) / sum(ar) OVER (PARTITION BY state)) / (ar + 1), 6) AS hazard FROM q)"


def hazards(spark, d):
    r = frame(spark, d).select(F.floor(F.col("x") * 3).cast("int").alias("state"), (1 + F.col("id") % 7).alias("duration"), F.when(F.col("hour") > 20, "session_end").otherwise("exit").alias("ending"))
    return models.state_model(r, "state", "duration", "ending", "state", 3, 6)


@query(RUN + " SELECT * FROM hz")
def censored_hazard(spark, d):
    return hazards(spark, d)


@query(RUN + ", t AS (SELECT state, greatest(1e-6, least(1 - 1e-6, avg(hazard))) AS h FROM hz WHERE age < 6 AND age >= 6 - 3 GROUP BY 1) SELECT state, age, hazard FROM hz WHERE age < 6 UNION ALL SELECT state, a.age, round(h, 6) FROM t, range(6, 11) AS a(age)")
def extended_hazard(spark, d):
    return models.extended_hazard(hazards(spark, d).withColumn("age", F.col("age").cast("long")), 10, 3)


MV = "mv(o, d, p) AS (VALUES (0, 1, 0.6::DOUBLE), (0, 2, 0.4::DOUBLE), (1, 0, 0.5::DOUBLE), (1, 2, 0.5::DOUBLE), (2, 0, 0.9::DOUBLE), (2, 1, 0.1::DOUBLE))"


@query(RUN + ", " + MV + ", ms AS (SELECT kind, CAST(floor(x * 3) AS INT) AS state, 1 + id % 6 AS age, sum(p) AS mass FROM e GROUP BY 1, 2, 3), j AS (SELECT kind, ms.state, ms.age, mass, hazard FROM ms JOIN hz ON hz.state = ms.state AND hz.age = ms.age), n AS (SELECT kind, state, least(age + 1, 6) AS age, mass * (1 - hazard) AS mass FROM j UNION ALL SELECT kind, d, 1, hazard * mass * p FROM j JOIN mv ON mv.o = j.state), g AS (SELECT kind, state, age, sum(mass) AS mass FROM n GROUP BY 1, 2, 3) SELECT kind, state, age, round(mass / sum(mass) OVER (PARTITION BY kind), 6) AS mass FROM g")
def state_age_step(spark, d):
    m = frame(spark, d).groupBy("kind", F.floor(F.col("x") * 3).cast("int").alias("state"), (1 + F.col("id") % 6).cast("int").alias("age")).agg(F.sum("p").alias("mass"))
    mv = spark.createDataFrame([(0, 1, 0.6), (0, 2, 0.4), (1, 0, 0.5), (1, 2, 0.5), (2, 0, 0.9), (2, 1, 0.1)], "origin int, destination int, p double")
    return models.propagated(m, ["kind"], hazards(spark, d), mv, 6).select("kind", "state", F.col("age").cast("long").alias("age"), F.round("mass", 6).alias("mass"))


@query()
def semimarkov_filter(spark, d):
    logs = models.log_emissions(["x", "p"], [[0.2, 0.5], [0.8, 0.1], [0.5, 0.9]], [[0.04, 0.09], [0.05, 0.02], [0.1, 0.1]])
    e = frame(spark, d).withColumn("logs", F.array(*logs))
    hazard = np.array([[0.1, 0.2, 0.3], [0.3, 0.3, 0.3], [0.5, 0.4, 0.3]])
    out = models.semimarkov_filter(e, ["kind", "session"], "id", "logs", hazard, np.array([[0, 0.5, 0.5], [0.5, 0, 0.5], [0.9, 0.1, 0]]), np.array([0.4, 0.3, 0.3]))
    return out.select("kind", "session", "id", "state", *[F.round(c, 6).alias(c) for c in ("entropy", "margin", "age", "leaves")])


@query()
def change_points(spark, d):
    s = frame(spark, d).groupBy("kind", "session").agg(F.avg("net").alias("net"), F.count(F.lit(1)).cast("double").alias("n"))
    out = models.change_points(s, ["kind"], "session", "net", "n")
    return out.select("kind", "session", *[F.round(c, 6).alias(c) for c in ("net", "change", "run_length", "level")])


@query(E + ", s AS (SELECT id, round(2 * p - x, 6) AS score, 2 * p - x >= 0.5 AS admitted FROM e) SELECT id, score, admitted, 'v1' AS rule, sha256(concat_ws('|', CAST(id AS VARCHAR), printf('%.6f', score), CAST(admitted AS VARCHAR), 'v1')) AS receipt FROM s")
def prediction_receipts(spark, d):
    return models.receipts(frame(spark, d), ["id"], 2 * F.col("p") - F.col("x"), 0.5, "v1")


PV = E + ", c AS (SELECT id, kind, session, [x / (x + p + 1), p / (x + p + 1), 1 / (x + p + 1)] AS a FROM e), l AS (SELECT *, lag(a) OVER (PARTITION BY kind, session ORDER BY id) AS b FROM c), h AS (SELECT id, kind, session, b IS NOT NULL AS k, -list_sum(list_transform(a, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)) AS ha, -list_sum(list_transform(b, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)) AS hb, -list_sum(list_transform([(a[1] + b[1]) / 2, (a[2] + b[2]) / 2, (a[3] + b[3]) / 2], lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)) AS hm FROM l)"


@query(PV + " SELECT kind, session, id, round(CASE WHEN k THEN sqrt(greatest(hm - (ha + hb) / 2, 0)) END, 6) AS velocity, round(CASE WHEN k THEN ha - hb END, 6) AS entropy_change FROM h")
def posterior_velocity(spark, d):
    s = F.col("x") + F.col("p") + 1
    e = frame(spark, d).select("kind", "session", "id", (F.col("x") / s).alias("a"), (F.col("p") / s).alias("b"), (1 / s).alias("c"))
    return models.posterior_velocity(e, ["kind", "session"], "id", ["a", "b", "c"])


@query()
def cluster_states(spark, d):
    """States of scaled features, and where they change."""
    from pyspark.sql import Window

    e = frame(spark, d)
    g = models.robust_geometry(e, ["kind"], ["net", "x"], F.col("session") < "2024-01-16")
    z = models.scaled(e, ["kind"], g, ["net", "x"], 3.0)
    centres = models.fit_clusters(z, ["net", "x"], 3)
    s = z.select("kind", "session", "id", models.nearest_state(["net", "x"], centres).alias("state"))
    w = Window.partitionBy("kind", "session").orderBy("id")
    return s.withColumn("changed", F.coalesce(F.col("state") != F.lag("state").over(w), F.lit(False)))
