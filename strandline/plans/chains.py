"""Queries of option chains. A chain is made of parts: type as root, size to the next five as strike, key as side, expiry, volatility and open interest."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import chains
from strandline.plans.registry import query, table

C = """WITH c0 AS (SELECT p_type AS root, [0, 1, 4, 10, 20, 60][(p_partkey // 2) % 6 + 1] AS dte, CAST(ceil(p_size / 5.0) * 5 AS INT) AS strike, CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'P' END AS side, p_partkey AS id, p_retailprice AS pr FROM part), c1 AS (SELECT root, dte, strike, side, min(id) AS id, arg_min(pr, id) AS pr FROM c0 GROUP BY 1, 2, 3, 4),
 c AS (SELECT root, dte, strike, side, id, round(pr / 100 - 0.3, 4) AS bid, round(pr / 100 + (id % 5) * 0.1, 4) AS ask, round(0.2 + (id % 17) / 50.0::DOUBLE, 4) AS iv, id % 97 AS oi, round(1 / (1 + exp((strike - 25) / 6.0::DOUBLE)) - CASE WHEN side = 'P' THEN 1 ELSE 0 END, 6) AS delta FROM c1)"""


def chain(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    c = p.select(F.col("p_type").alias("root"), F.element_at(F.array(*[F.lit(x) for x in (0, 1, 4, 10, 20, 60)]), (F.floor(k / 2) % 6 + 1).cast("int")).alias("dte"), (F.ceil(F.col("p_size") / 5) * 5).cast("int").alias("strike"), F.when(k % 2 == 0, "C").otherwise("P").alias("side"), k.alias("id"), F.col("p_retailprice").alias("pr"))
    c = c.groupBy("root", "dte", "strike", "side").agg(F.min("id").alias("id"), F.min_by("pr", "id").alias("pr"))
    i = F.col("id")
    return c.select("root", "dte", "strike", "side", "id", F.round(F.col("pr") / 100 - 0.3, 4).alias("bid"), F.round(F.col("pr") / 100 + (i % 5) * 0.1, 4).alias("ask"), F.round(0.2 + (i % 17) / 50, 4).alias("iv"), (i % 97).alias("oi"), F.round(1 / (1 + F.exp((F.col("strike") - 25) / 6)) - F.when(F.col("side") == "P", 1).otherwise(0), 6).alias("delta"))


@query(C + " SELECT id, CASE WHEN side = 'C' AND strike <> 30 AND id % 3 <> 0 THEN 100 END AS multiplier FROM c")
def contract_multiplier(spark, d):
    c = chain(spark, d)
    written = F.when(F.col("strike") == 30, F.lit(31)).otherwise(F.col("strike")) * 1000
    text = F.concat(F.when(F.col("side") == "C", "ABC").otherwise("XYZ"), F.lit("240119"), F.col("side"), F.lpad(written.cast("string"), 8, "0"))
    return c.select("id", chains.contract_multiplier(text, F.lit("abc"), F.col("strike"), F.col("id") % 3 != 0).alias("multiplier"))


@query(C + ", b AS (SELECT root, list(DISTINCT dte) AS l FROM c GROUP BY 1), x AS (SELECT root, unnest([{'b': '0DTE', 'd': list_min(list_filter(l, lambda v: v = 0))}, {'b': '1DTE', 'd': list_min(list_filter(l, lambda v: v = 1))}, {'b': '3_5DTE', 'd': list_min(list_filter(l, lambda v: v IN (3, 4, 5)))}]) AS s FROM b) SELECT root, s.b AS bucket, s.d AS dte, CASE WHEN s.d IS NULL THEN 'no_expiry_in_bucket' END AS reason FROM x")
def expiry_bucket(spark, d):
    return chains.expiry_buckets(chain(spark, d))


@query(C + ", s AS (SELECT DISTINCT root, dte, strike FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY root, dte ORDER BY strike) AS i FROM s), a AS (SELECT root, dte, arg_min(i, abs(strike - 25) * 1000 + strike) AS ai FROM n GROUP BY 1, 2) SELECT n.root, n.dte, strike, unnest(['C', 'P']) AS side FROM n JOIN a ON a.root = n.root AND a.dte = n.dte WHERE abs(i - ai) <= 2")
def bounded_requests(spark, d):
    return chains.bounded_requests(chain(spark, d), 25.0, 2)


PAIR = C + ", pr AS (SELECT a.root, a.dte, a.strike, a.id AS ci, a.bid AS cb, a.ask AS ca, a.iv AS cv, a.oi AS co, z.id AS pi, z.bid AS pb, z.ask AS pa, z.iv AS pv, z.oi AS po FROM c a JOIN c z ON a.root = z.root AND a.dte = z.dte AND a.strike = z.strike AND a.side = 'C' AND z.side = 'P')"
RANK = "round(abs(ln(strike / 25.0::DOUBLE)), 9), -least(co, po), round((ca - cb + pa - pb) / ((ca + cb) / 2 + (pa + pb) / 2), 9), round(abs(cv - pv), 9), strike, ci, pi"


def atm(name: str, low: int, high: int) -> str:
    return f", {name}0 AS (SELECT *, min(dte) OVER (PARTITION BY root) AS fd FROM pr WHERE dte BETWEEN {low} AND {high}), {name} AS (SELECT * FROM {name}0 WHERE dte = fd QUALIFY row_number() OVER (PARTITION BY root ORDER BY {RANK}) = 1)"


@query(PAIR + atm("st", 3, 45) + " SELECT root, dte, strike, ci AS call_id, pi AS put_id, CASE WHEN cb <= 0 OR ca < cb OR co <= 0 THEN 'selected_call_quote' WHEN pb <= 0 OR pa < pb OR po <= 0 THEN 'selected_put_quote' WHEN cv NOT BETWEEN 0.005 AND 5 THEN 'selected_call_iv' WHEN pv NOT BETWEEN 0.005 AND 5 THEN 'selected_put_iv' ELSE 'selected' END AS reason FROM st")
def atm_straddle(spark, d):
    s = chains.atm_straddle(chain(spark, d), 25.0, 3, 45)
    return s.select("root", "dte", "strike", F.col("c.id").alias("call_id"), F.col("p.id").alias("put_id"), "reason")


@query(PAIR + atm("st", 1, 1) + " SELECT root, strike, ci AS call_id, pi AS put_id FROM st")
def one_day_pair(spark, d):
    return chains.atm_straddle(chain(spark, d), 25.0, 1, 1).select("root", "strike", F.col("c.id").alias("call_id"), F.col("p.id").alias("put_id"))


PF = "(ca + cb) / 2 + (pa + pb) / 2"


@query(PAIR + atm("st", 3, 45) + f" SELECT root, dte, strike, round((cv + pv) / 2, 6) AS atm_iv, round(cv - pv, 6) AS iv_gap, round({PF}, 6) AS straddle, round(({PF}) / 25, 6) AS straddle_pct, round((ca - cb + pa - pb) / ({PF}), 6) AS spread, co + po AS oi, round(ln(strike / 25.0::DOUBLE), 6) AS moneyness, round(({PF}) / 25 * sqrt(15 / greatest(dte * 390.0, 15.0)), 6) AS move_15m FROM st")
def option_features(spark, d):
    return chains.primary_features(chains.atm_straddle(chain(spark, d), 25.0, 3, 45), 25.0)


def delta(name: str, side: str, target: float) -> str:
    return f", {name} AS (SELECT root, dte, iv, strike, round(abs(delta - ({target})), 9) AS d FROM c WHERE side = '{side}' QUALIFY row_number() OVER (PARTITION BY root, dte ORDER BY round(abs(delta - ({target})), 9), strike, id) = 1)"


@query(PAIR + atm("st", 3, 45) + atm("bk", 46, 90) + delta("dp", "P", -0.25) + delta("dc", "C", 0.25) + " SELECT st.root, round(CASE WHEN dp.d <= 0.1 THEN dp.iv END - CASE WHEN dc.d <= 0.1 THEN dc.iv END, 6) AS skew, round(round((bk.cv + bk.pv) / 2, 6) - round((st.cv + st.pv) / 2, 6), 6) AS term FROM st LEFT JOIN dp ON dp.root = st.root AND dp.dte = st.dte LEFT JOIN dc ON dc.root = st.root AND dc.dte = st.dte LEFT JOIN bk ON bk.root = st.root")
def skew_and_term(spark, d):
    c = chain(spark, d)
    return chains.skew_and_term(c, chains.atm_straddle(c, 25.0, 3, 45), 25.0)


SF = C + ", g AS (SELECT root, round(avg(iv) FILTER (WHERE abs(strike - 25) <= 5), 6) AS atm, round(avg(iv) FILTER (WHERE strike < 20), 6) AS low, round(avg(iv) FILTER (WHERE strike > 30), 6) AS high, round(avg(iv) FILTER (WHERE dte <= 5), 6) AS front, round(avg(iv) FILTER (WHERE dte > 5), 6) AS back, CAST(sum(CASE WHEN side = 'C' THEN oi ELSE 0 END) AS BIGINT) AS call_oi, CAST(sum(CASE WHEN side = 'P' THEN oi ELSE 0 END) AS BIGINT) AS put_oi FROM c GROUP BY 1), sf AS (SELECT *, round(low + high - 2 * atm, 6) AS smile, round(back - front, 6) AS slope, round(put_oi / nullif(call_oi, 0), 6) AS put_call, round(atm - 0.3, 6) AS premium FROM g)"


@query(SF + " SELECT * FROM sf")
def options_surface(spark, d):
    return chains.surface(chain(spark, d), 25.0, F.lit(0.3))


@query(SF + ", s AS (SELECT avg(front) AS fm, stddev_samp(front) AS fs, avg(back) AS bm, stddev_samp(back) AS bs FROM sf) SELECT root, round((front - fm) / fs - (back - bm) / bs, 5) AS front_mismatch FROM sf, s")
def front_mismatch(spark, d):
    f = chains.surface(chain(spark, d), 25.0, F.lit(0.3))
    scale = f.agg(*[x for c in ("front", "back") for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd"))])
    return chains.mismatch(f, {"front_mismatch": ("front", "back")}, scale).select("root", "front_mismatch")


DS = C + ", u AS (SELECT *, min(dte) OVER (PARTITION BY root) AS fd FROM c WHERE dte BETWEEN 4 AND 20 AND bid > 0 AND ask >= bid AND oi > 0), j AS (SELECT a.root, a.side, a.dte, a.id AS li, z.id AS si, round(a.ask - z.bid, 6) AS debit, -least(a.oi, z.oi) AS r1, round((a.ask - a.bid + z.ask - z.bid) / ((a.ask + a.bid) / 2 + (z.ask + z.bid) / 2), 9) AS r2, round(round(abs(abs(a.delta) - 0.5), 9) + round(abs(abs(z.delta) - 0.25), 9), 9) AS r3 FROM u a JOIN u z ON a.root = z.root AND a.side = z.side AND a.dte = a.fd AND z.dte = z.fd AND abs(abs(a.delta) - 0.5) <= 0.2 AND abs(abs(z.delta) - 0.25) <= 0.2 AND CASE WHEN a.side = 'C' THEN z.strike > a.strike ELSE z.strike < a.strike END)"


@query(DS + " SELECT root, side, dte, li AS long_id, si AS short_id, debit FROM j QUALIFY row_number() OVER (PARTITION BY root, side ORDER BY r1, r2, r3, li, si) = 1")
def debit_spreads(spark, d):
    return chains.debit_spreads(chain(spark, d), 4, 20)


@query(C + ", l AS (SELECT *, CASE WHEN side = 'C' THEN 1 ELSE -2 END AS q FROM c) SELECT root, dte, round(sum(q * CASE WHEN q > 0 THEN ask ELSE bid END * 100), 6) AS cost, round(sum(q * CASE WHEN q > 0 THEN bid + 0.5 ELSE ask + 0.5 END * 100), 6) AS value, round(sum(q * (CASE WHEN q > 0 THEN bid + 0.5 ELSE ask + 0.5 END - CASE WHEN q > 0 THEN ask ELSE bid END) * 100 - 2 * abs(q) * 0.65), 6) AS pnl FROM l GROUP BY 1, 2")
def option_position_pnl(spark, d):
    l = chain(spark, d).withColumns({"q": F.when(F.col("side") == "C", 1).otherwise(-2), "xb": F.col("bid") + 0.5, "xa": F.col("ask") + 0.5})
    return chains.position_pnl(l, ["root", "dte"], "q", "bid", "ask", "xb", "xa")


@query(PAIR + ", k AS (SELECT root, dte, strike, row_number() OVER (PARTITION BY root, dte ORDER BY abs(strike - 25), strike) AS k FROM pr), r AS (SELECT root, dte, strike, row_number() OVER (PARTITION BY root ORDER BY dte, k) AS rank FROM k WHERE k <= 3) SELECT *, rank * 2 <= 10 AS planned FROM r")
def contract_plan(spark, d):
    return chains.contract_plan(chain(spark, d), 25.0, 1, 10)


SO = "WITH e AS (SELECT user_id AS k, event_id AS id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'click'), q AS (SELECT user_id AS k, epoch_us(ts) / 1e6 AS t, value FROM events WHERE event_type = 'view'), x AS (SELECT e.*, unnest([3600.0, 86400.0]) AS h FROM e), j AS (SELECT x.id, h, q.value, q.t - (x.t + h) AS lag FROM x ASOF LEFT JOIN q ON x.k = q.k AND x.t + h <= q.t)"


@query(SO + " SELECT id, h AS horizon, CASE WHEN lag <= 172800 THEN value END AS value, CASE WHEN lag <= 172800 THEN round(lag, 3) END AS lag FROM j")
def shadow_outcomes(spark, d):
    from strandline.operators import micro

    e = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("id"), micro.seconds("ts").alias("t"), "event_type", "value")
    o = chains.shadow_outcomes(e.where("event_type = 'click'").select("k", "id", "t"), e.where("event_type = 'view'"), "k", "t", [3600.0, 86400.0], 172800.0)
    return o.select("id", "horizon", "value", "lag")


SV = PAIR + ", s AS (SELECT *, min(dte) OVER (PARTITION BY root) AS fd FROM pr), f AS (SELECT *, lead(cb) OVER w AS ucb, lead(ca) OVER w AS uca, lag(pb) OVER w AS dpb, lag(pa) OVER w AS dpa FROM s WHERE dte = fd WINDOW w AS (PARTITION BY root ORDER BY strike)), b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY root ORDER BY abs(strike - 25), strike) = 1), v AS (SELECT root, unnest([{'n': 'long_call', 'e': ca, 'x': cb + 1.5}, {'n': 'long_put', 'e': pa, 'x': greatest(pb - 1.5, 0)}, {'n': 'straddle', 'e': ca + pa, 'x': cb + 1.5 + greatest(pb - 1.5, 0)}, {'n': 'call_debit', 'e': ca - ucb, 'x': cb + 1.5 - (uca + 1.5)}, {'n': 'put_debit', 'e': pa - dpb, 'x': greatest(pb - 1.5, 0) - greatest(dpa - 1.5, 0)}]) AS q FROM b)"


@query(SV + " SELECT root, q.n AS structure, round(q.e, 6) AS entry, round(q.x, 6) AS exit, round(q.x - q.e, 6) AS pnl FROM v")
def shadow_structures(spark, d):
    return chains.structure_values(chains.pairs(chain(spark, d)), 25.0, 1.5)


IB = PAIR + ", a AS (SELECT root, dte, strike AS atm FROM pr QUALIFY row_number() OVER (PARTITION BY root, dte ORDER BY abs(strike - 25), strike) = 1), l AS (SELECT c.root, c.dte, side, CASE WHEN side = 'C' THEN strike - atm ELSE atm - strike END AS aw FROM c JOIN a ON a.root = c.root AND a.dte = c.dte), w AS (SELECT root, dte, min(aw) AS width FROM (SELECT root, dte, aw FROM l WHERE aw > 0 AND aw >= 0.25 GROUP BY 1, 2, 3 HAVING count(DISTINCT side) = 2) GROUP BY 1, 2)"


@query(IB + " SELECT k.root, k.dte, atm, width, CASE WHEN atm IS NULL THEN 'atm_pair_unavailable' WHEN width IS NULL THEN 'symmetric_wings_unavailable' ELSE 'available' END AS reason FROM (SELECT DISTINCT root, dte FROM c) k LEFT JOIN a USING (root, dte) LEFT JOIN w USING (root, dte)")
def iron_butterfly(spark, d):
    return chains.iron_butterfly(chain(spark, d), 25.0)


IC = C + delta("sc", "C", 0.25) + delta("sp", "P", -0.25) + delta("lc", "C", 0.1) + delta("lp", "P", -0.1) + ", k AS (SELECT DISTINCT root, dte FROM c), j AS (SELECT k.*, sc.strike AS short_call, sp.strike AS short_put, lc.strike AS long_call, lp.strike AS long_put, greatest(sc.d, sp.d, lc.d, lp.d) AS far FROM k LEFT JOIN sc USING (root, dte) LEFT JOIN sp USING (root, dte) LEFT JOIN lc USING (root, dte) LEFT JOIN lp USING (root, dte))"


@query(IC + " SELECT root, dte, short_call, short_put, long_call, long_put, CASE WHEN short_call IS NULL OR short_put IS NULL OR long_call IS NULL OR long_put IS NULL THEN 'missing_greek' WHEN far > 0.1 THEN 'delta_tolerance_failed' WHEN NOT (long_put < short_put AND short_put < short_call AND short_call < long_call) THEN 'invalid_strike_ordering' WHEN long_call - short_call <> short_put - long_put THEN 'asymmetric_wings' ELSE 'available' END AS reason FROM j")
def iron_condor(spark, d):
    return chains.iron_condor(chain(spark, d))


CS = C + ", s AS (SELECT DISTINCT root, dte, strike FROM c WHERE side = 'C'), a AS (SELECT root, dte, strike AS sh FROM s QUALIFY row_number() OVER (PARTITION BY root, dte ORDER BY abs(strike - 25), strike) = 1), w AS (SELECT a.root, a.dte, sh AS short, min(CASE WHEN strike - sh > 0 AND strike - sh >= 0.25 THEN strike - sh END) AS width FROM a JOIN s ON s.root = a.root AND s.dte = a.dte GROUP BY 1, 2, 3)"


@query(CS + " SELECT root, dte, short, width, CASE WHEN width IS NULL THEN 'protective_wing_unavailable' ELSE 'available' END AS reason FROM w")
def credit_spread(spark, d):
    return chains.credit_spread(chain(spark, d), "C", 25.0)


@query(CS + ", x AS (SELECT w.root, w.dte, short, short + width AS wing, width, a.bid AS sb, a.ask AS sa, z.bid AS wb, z.ask AS wa FROM w JOIN c a ON a.root = w.root AND a.dte = w.dte AND a.strike = short AND a.side = 'C' JOIN c z ON z.root = w.root AND z.dte = w.dte AND z.strike = short + width AND z.side = 'C'), y AS (SELECT *, sb - wa AS cr, sa + 0.4 - greatest(wb + 0.4, 0) AS cl FROM x) SELECT root, dte, short, wing, round(cr, 6) AS credit, round(cl, 6) AS close, round(cr - cl, 6) AS pnl, round(width - cr, 6) AS most_loss FROM y")
def credit_shadow(spark, d):
    return chains.credit_shadow(chain(spark, d), "C", 25.0, 0.4)


@query(C + " SELECT id, round(iv * sqrt(15 / 98280.0::DOUBLE), 6) AS sigma, round(iv * sqrt(15 / 98280.0::DOUBLE) * sqrt(2 / pi()), 6) AS expected FROM c")
def iv_moves(spark, d):
    from strandline.operators import outcomes

    return chain(spark, d).select("id", F.round(outcomes.sigma(F.col("iv"), 15), 6).alias("sigma"), F.round(outcomes.expected_absolute(F.col("iv"), 15), 6).alias("expected"))
