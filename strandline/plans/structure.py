"""Queries of state events, episodes and loops over hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.numbers import log, ratio
from strandline.functions.windows import ordered
from strandline.operators import events, structure
from strandline.plans.registry import H, RUNS, W, query, table
from strandline.sources import bars

SESSION = ["symbol", "session"]
UP = f"{W} ROWS UNBOUNDED PRECEDING)"


def back(n: int, first: int = 0) -> str:
    return f"{W} ROWS BETWEEN {n} PRECEDING AND {'CURRENT ROW' if not first else f'{first} PRECEDING'})"


FEATURES = H + f""", f0 AS (SELECT *, round(close / open - 1, 6) AS bar_return, lag(close) {W}) AS last_close, lag(high) {W}) AS last_high, max(high) {back(12, 1)} AS recent_high, min(low) {back(12, 1)} AS recent_low, coalesce(high > max(high) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS new_high, coalesce(low < min(low) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS new_low,
 first_value(open) {UP} AS first_open, min(low) {UP} AS low_so_far, sum((high + low + close) / 3 * volume) {UP} / sum(volume) {UP} AS vwap, abs(close - lag(close) {W})) AS step, CASE WHEN count(high) {back(11)} >= 3 THEN max(high) {back(11)} END AS high_12, CASE WHEN count(low) {back(11)} >= 3 THEN min(low) {back(11)} END AS low_12, lag(close, 12) {W}) AS ago_12,
 max(CASE WHEN bar_index < 3 THEN high END) OVER (PARTITION BY symbol, session) AS orh, min(CASE WHEN bar_index < 3 THEN low END) OVER (PARTITION BY symbol, session) AS orl, {', '.join(f'round(close / lag(close, {k}) {W}) - 1, 6) AS prior_{k}' for k in (3, 6, 12))}, avg(volume) {back(2)} AS volume_3, avg(volume) {back(11, 3)} AS volume_9 FROM b),
 f1 AS (SELECT *, CASE WHEN bar_index >= 3 THEN orl END AS or_low, CASE WHEN bar_index >= 3 THEN (orh + orl) / 2 END AS or_mid FROM f0),
 f AS (SELECT *, round((close - low) / nullif(high - low, 0), 6) AS close_location, round((high - greatest(open, close)) / nullif(high - low, 0), 6) AS upper_wick, round((least(open, close) - low) / nullif(high - low, 0), 6) AS lower_wick, round(close / vwap - 1, 6) AS dist_vwap, round(close / or_mid - 1, 6) AS dist_mid, round(close / low_so_far - 1, 6) AS dist_low, round(close / first_open - 1, 6) AS dist_open,
 coalesce(ago_12 + (high_12 - ago_12) * 0.5, (high_12 + low_12) / 2) AS impulse_mid, round(high_12 / ago_12 - 1, 6) AS impulse, round(volume_3 / volume_9, 6) AS volume_ratio, round(close / high_12 - 1, 6) AS depth, round(close / low_12 - 1, 6) AS reclaim, {', '.join(f'round(abs(close - lag(close, {k}) {W})) / nullif(sum(step) {back(k - 1)}, 0), 6) AS efficiency_{k}' for k in (6, 12))} FROM f1)"""
NAMED = "bar_return prior_3 prior_6 prior_12 close_location upper_wick lower_wick dist_vwap dist_mid dist_low dist_open impulse volume_ratio depth reclaim efficiency_6 efficiency_12".split()
EVENTS = FEATURES + ", h AS (SELECT *, " + ", ".join(f"coalesce({r}, false) AS r_{n}" for n, r in structure.RULES.items()) + " FROM f), o AS (SELECT *, concat_ws('|', " + ", ".join(f"CASE WHEN r_{n} THEN '{n}' END" for n in structure.RULES) + ") AS overlap FROM h), ev AS (" + " UNION ALL ".join(f"SELECT symbol, session, bar_index, overlap, '{n}' AS state, round(({' + '.join(f'CASE WHEN coalesce({p}, false) THEN 1.0::DOUBLE ELSE 0.0 END' for p in structure.PARTS[n])}) / {len(structure.PARTS[n])}, 6) AS confidence FROM (SELECT *, lag(r_{n}) {W}) AS was FROM o) WHERE r_{n} AND NOT coalesce(was, false)" for n in structure.RULES) + ")"


def greedy(events_: str, keys: str, spacing: int) -> str:
    """SQL: g, the events that a greedy spacing keeps; the query must begin with WITH RECURSIVE."""
    same = " AND ".join(f"e.{k.strip()} = g.{k.strip()}" for k in keys.split(","))
    return f", g AS (SELECT {keys}, min(bar_index) AS bar_index FROM {events_} GROUP BY {keys} UNION ALL SELECT {', '.join('g.' + k.strip() for k in keys.split(','))}, (SELECT min(e.bar_index) FROM {events_} e WHERE {same} AND e.bar_index >= g.bar_index + {spacing}) FROM g WHERE g.bar_index IS NOT NULL)"


def recursive(sql: str) -> str:
    return "WITH RECURSIVE " + sql.removeprefix("WITH ")


@query(FEATURES + f" SELECT symbol, session, bar_index, {', '.join(NAMED)}, new_high, new_low FROM f")
def event_features(spark, d):
    return structure.event_features(bars.hourly(spark, d)).select(*SESSION, "bar_index", *NAMED, "new_high", "new_low")


@query(recursive(EVENTS + greedy("ev", "symbol, session, state", 4)) + " SELECT symbol, session, state, bar_index, confidence, overlap FROM g JOIN ev USING (symbol, session, state, bar_index) WHERE bar_index IS NOT NULL")
def state_events(spark, d):
    return structure.state_events(structure.event_features(bars.hourly(spark, d)), 4)


EP = H + f", x AS (SELECT symbol, session, bar_index, close, close <= 60 AS n, lag(close <= 60) {W}) AS was FROM b), e AS (SELECT * FROM x WHERE n AND was = false)"


@query(recursive(EP + greedy("e", "symbol, session", 6)) + " SELECT symbol, session, bar_index, close FROM g JOIN e USING (symbol, session, bar_index)")
def fresh_quiet_episodes(spark, d):
    return structure.fresh_episodes(bars.hourly(spark, d), "close", 60.0, 6)


EU = H + f", x AS (SELECT symbol, session, bar_index, close, close >= 150 AS n, lag(close >= 150) {W}) AS was FROM b), e AS (SELECT * FROM x WHERE n AND was = false)"


@query(recursive(EU + greedy("e", "symbol, session", 4)) + " SELECT symbol, session, bar_index, close FROM g JOIN e USING (symbol, session, bar_index)")
def fresh_episodes(spark, d):
    return structure.fresh_episodes(bars.hourly(spark, d), "close", 150.0, 4, below=False)


@query(H + f", x AS (SELECT symbol, session, bar_index, close < 150 AS n, lag(close < 150) {W}) AS w, bar_index - lag(bar_index) {W}) AS gp FROM b), y AS (SELECT *, sum(CASE WHEN n AND (NOT coalesce(w, false) OR gp > 1) THEN 1 ELSE 0 END) {W} ROWS UNBOUNDED PRECEDING) AS i FROM x) SELECT symbol, session, min(bar_index) AS start, max(bar_index) AS \"end\", count(*) AS members FROM y WHERE n GROUP BY symbol, session, i")
def quiet_run_clusters(spark, d):
    return structure.clustered_runs(bars.hourly(spark, d), F.col("close") < 150, 1)


@query(H + f", x AS (SELECT symbol, session, bar_index, high / low AS q FROM b WHERE high / low >= 3), y AS (SELECT *, max(bar_index + 2) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far, lag(bar_index) {W}) AS lb FROM x), z AS (SELECT *, sum(CASE WHEN coalesce(bar_index > far OR bar_index - lb > 3, false) THEN 1 ELSE 0 END) {W} ROWS UNBOUNDED PRECEDING) AS i FROM y) SELECT symbol, session, min(bar_index) AS start, max(bar_index + 2) AS \"end\", count(*) AS members, round(max(q), 6) AS largest, arg_max(bar_index, q) AS \"at\" FROM z GROUP BY symbol, session, i")
def surprise_clusters(spark, d):
    b = bars.hourly(spark, d).withColumn("q", ratio("high", "low"))
    return structure.surprise_clusters(b, "q", 3.0, 2, 3)


@query("WITH i AS (SELECT l_suppkey AS k, datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS s, datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) + l_linenumber AS e FROM lineitem), f AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM i), g AS (SELECT *, sum(CASE WHEN s > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM f) SELECT k, CAST(min(s) AS INT) AS s, CAST(max(e) AS INT) AS e, count(*) AS members FROM g GROUP BY k, n")
def family_intervals(spark, d):
    s = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date"))
    return structure.adjacent_intervals(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), s.alias("s"), (s + F.col("l_linenumber")).alias("e")), ["k"], "s", "e")


@query(H + ", s AS (SELECT symbol, session, max(high) > 470 AS f FROM b GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session) AS n, count(*) OVER (PARTITION BY symbol) AS t, row_number() OVER (PARTITION BY symbol ORDER BY session) - row_number() OVER (PARTITION BY symbol, f ORDER BY session) AS i FROM s) SELECT symbol, min(session) AS start, max(session) AS \"end\", count(*) AS sessions, max(n) = max(t) AS censored FROM n WHERE f GROUP BY symbol, i")
def episode_ledgers(spark, d):
    s = bars.hourly(spark, d).groupBy(*SESSION).agg((F.max("high") > 470).alias("f"))
    return structure.flag_episodes(s, ["symbol"], "session", "f")


PA = H + ", a AS (SELECT symbol, session, bar_index, close AS ref, CASE WHEN close > open THEN 1 ELSE -1 END AS dr FROM b WHERE bar_index IN (4, 10, 16)), p AS (SELECT a.*, b.high AS ph, b.low AS pl, b.close AS pc FROM a LEFT JOIN b ON b.symbol = a.symbol AND b.session = a.session AND b.bar_index = a.bar_index + 2), q AS (SELECT *, dr * 10000 * (pc / ref - 1) AS c, CASE WHEN dr = 1 THEN 10000 * (ph / ref - 1) ELSE -10000 * (pl / ref - 1) END AS g, CASE WHEN dr = 1 THEN -10000 * (pl / ref - 1) ELSE 10000 * (ph / ref - 1) END AS n FROM p)"


@query(PA + " SELECT symbol, session, bar_index, pc AS post_close, round(c, 4) AS signed_close, round(g - n, 4) AS balance, coalesce(c > 0 AND g > n, false) AS accepted FROM q")
def price_acceptance(spark, d):
    b = bars.hourly(spark, d)
    anchors = b.where(F.col("bar_index").isin(4, 10, 16)).select(*SESSION, "bar_index", F.col("close").alias("ref"), F.when(F.col("close") > F.col("open"), 1).otherwise(-1).alias("dr"))
    p = structure.price_acceptance(structure.post_anchor_bar(anchors, b, 2), "ref", "dr")
    return p.select(*SESSION, "bar_index", "post_close", "signed_close", "balance", "accepted")


def grams(lengths) -> str:
    """SQL: gr, stretches of runs (path) by the run they end at."""
    most = max(lengths)
    w = f"OVER (PARTITION BY symbol, session ORDER BY run ROWS {most - 1} PRECEDING)"
    return f", gb AS (SELECT symbol, session, run, s, list(state) {w} AS l FROM r), gr AS (SELECT symbol, session, run, s, list_slice(l, len(l) - n + 1, len(l)) AS path FROM gb, (SELECT unnest({list(lengths)}) AS n) WHERE len(l) >= n)"


def rotations(name: str) -> str:
    return f"list_transform(range(1, len({name}) + 1), lambda i: list_concat(list_slice({name}, i, len({name})), list_slice({name}, 1, i - 1)))"


@query(RUNS + grams([3, 4]) + " SELECT array_to_string(path, ',') AS path, count(*) AS n FROM gr GROUP BY 1")
def state_path_ngrams(spark, d):
    return structure.path_counts(bars.hourly(spark, d), [3, 4])


WALKS = RUNS + grams([3, 4, 5, 6, 7]) + f", w0 AS (SELECT symbol, session, run, s, list_slice(path, 1, len(path) - 1) AS core FROM gr WHERE path[1] = path[-1]), w1 AS (SELECT *, list_sort({rotations('core')})[1] AS walk FROM w0), w2 AS (SELECT *, list_min(list_filter(range(1, len(walk) + 1), lambda p: len(walk) % p = 0 AND list_slice(walk, 1, len(walk) - p) = list_slice(walk, p + 1, len(walk)))) AS p FROM w1), w3 AS (SELECT *, list_slice(walk, 1, p) AS root FROM w2), wk AS (SELECT symbol, session, run, s AS start, array_to_string(walk, ',') AS walk, array_to_string(root, ',') AS root, CASE WHEN len(list_distinct(root)) <> len(root) THEN 'composite' WHEN len(walk) > len(root) THEN 'repeat' ELSE 'primitive' END AS kind, CAST(len(walk) // len(root) AS INT) AS dp, CAST(len(list_filter(walk, lambda x: x = walk[1])) AS INT) AS pt FROM w3)"


@query(WALKS + " SELECT symbol, session, CAST(run AS BIGINT) AS run, start, walk, root, CASE WHEN kind = 'composite' THEN 1 ELSE dp END AS depth, kind, CASE WHEN kind = 'composite' THEN pt ELSE dp END AS parts FROM wk")
def closed_walks(spark, d):
    return structure.closed_walks(bars.hourly(spark, d))


CENSUS = WALKS + ", pr AS (SELECT * FROM wk WHERE kind = 'primitive'), cs0 AS (SELECT walk, count(*) AS n, count(DISTINCT symbol) AS symbols, count(DISTINCT symbol || '|' || session) AS sessions FROM pr GROUP BY 1), cm AS (SELECT walk, max(c) AS m FROM (SELECT walk, symbol, count(*) AS c FROM pr GROUP BY 1, 2) GROUP BY 1), cs AS (SELECT walk, n, symbols, sessions, round(m / n, 6) AS top_share, concat_ws(',', CASE WHEN n < 4 THEN 'count' END, CASE WHEN symbols < 3 THEN 'breadth' END, CASE WHEN m / n > 0.6 THEN 'concentration' END) AS reasons FROM cs0 JOIN cm USING (walk))"


def _census(spark, d):
    return structure.loop_census(structure.closed_walks(bars.hourly(spark, d)), 4, 0.6)


@query(CENSUS + " SELECT * FROM cs")
def loop_census(spark, d):
    return _census(spark, d)


DICT = CENSUS + ", dc0 AS (SELECT walk, n, n / (SELECT sum(n) FROM cs) AS mg FROM cs WHERE reasons = ''), dc AS (SELECT walk, row_number() OVER (ORDER BY n DESC, walk) AS rank, mg, sum(mg) OVER (ORDER BY n DESC, walk ROWS UNBOUNDED PRECEDING) AS cv FROM dc0)"


def _dictionary(spark, d):
    return structure.select_dictionary(_census(spark, d), 6, 0.005)


@query(DICT + " SELECT walk, rank, round(mg, 6) AS marginal, round(cv, 6) AS coverage FROM dc WHERE rank <= 6 AND mg >= 0.005")
def loop_dictionary(spark, d):
    return _dictionary(spark, d)


ORIENT = DICT + f", di AS (SELECT walk, list_transform(string_split(walk, ','), lambda x: CAST(x AS INT)) AS core FROM dc WHERE rank <= 6 AND mg >= 0.005), og AS (SELECT walk, unnest(list_distinct({rotations('core')})) AS o FROM di), oo AS (SELECT walk, list_concat(o, [o[1]]) AS path FROM og)"


@query(ORIENT + ", px AS (SELECT walk, path, unnest(range(2, len(path))) AS k FROM oo) SELECT walk, array_to_string(path, ',') AS orientation, array_to_string(list_slice(path, 1, k), ',') AS prefix, CAST(k AS INT) AS progress, CAST(len(path) - k AS INT) AS remaining FROM px")
def orientation_registry(spark, d):
    return structure.prefix_registry(_dictionary(spark, d))


DONE = ORIENT + ", cp0 AS (SELECT symbol, session, run, s, walk, len(gr.path) AS states FROM gr JOIN oo ON array_to_string(gr.path, ',') = array_to_string(oo.path, ',')), cp AS (SELECT *, count(*) OVER (PARTITION BY symbol, session, run) > 1 AS tied, states > min(states) OVER (PARTITION BY symbol, session, run) AS nested FROM cp0)"


def _done(spark, d):
    return structure.completions(bars.hourly(spark, d), _dictionary(spark, d))


@query(DONE + " SELECT symbol, session, CAST(run AS BIGINT) AS run, s AS start, walk, CAST(states AS INT) AS states, tied, nested AS holds_nested FROM cp")
def loop_completions(spark, d):
    return _done(spark, d)


ALIVE = ORIENT + ", px AS (SELECT walk, path, unnest(range(2, len(path))) AS k FROM oo), pf AS (SELECT gr.symbol, gr.session, gr.run, gr.s, px.walk, array_to_string(px.path, ',') AS orientation, px.k AS progress, len(px.path) - px.k AS remaining FROM gr2 gr JOIN px ON array_to_string(gr.path, ',') = array_to_string(list_slice(px.path, 1, px.k), ','))"
ALIVE = ALIVE.replace(", px AS (SELECT walk", grams([2, 3, 4, 5, 6]).replace("gb AS", "gb2 AS").replace("FROM gb,", "FROM gb2,").replace("gr AS", "gr2 AS") + ", px AS (SELECT walk", 1)


def _alive(spark, d):
    return structure.active_prefixes(bars.hourly(spark, d), _dictionary(spark, d))


@query(ALIVE + " SELECT symbol, session, CAST(run AS BIGINT) AS run, s AS start, walk, orientation, CAST(progress AS INT) AS progress, CAST(remaining AS INT) AS remaining FROM pf")
def active_prefixes(spark, d):
    return _alive(spark, d)


@query(DONE + ", pd AS (SELECT symbol, session, s AS a, array_to_string(list_sort(list(DISTINCT walk)), '|') AS loops FROM cp GROUP BY 1, 2, 3), nx AS (SELECT b.symbol, b.session, b.bar_index, min(pd.a) AS a FROM b LEFT JOIN pd ON pd.symbol = b.symbol AND pd.session = b.session AND pd.a > b.bar_index AND pd.a <= b.bar_index + 5 GROUP BY 1, 2, 3) SELECT nx.symbol, nx.session, nx.bar_index, CAST(nx.a - nx.bar_index AS INT) AS lead, coalesce(loops, 'none') AS loops FROM nx LEFT JOIN pd ON pd.symbol = nx.symbol AND pd.session = nx.session AND pd.a = nx.a")
def first_completions(spark, d):
    return structure.first_completions(bars.hourly(spark, d), _done(spark, d), 5)


ROUTE = ALIVE + ", rd AS (SELECT *, progress / (progress + remaining) AS dp FROM pf), rk AS (SELECT symbol, session, run, walk, count(*) AS c FROM rd GROUP BY ALL), re AS (SELECT symbol, session, run, sum(c) AS alive, count(*) AS kinds, sum(c * ln(c)) AS e FROM rk GROUP BY ALL), rt AS (SELECT symbol, session, run, list_reverse_sort(list(dp)) AS l FROM rd GROUP BY ALL), rf0 AS (SELECT symbol, session, run, CAST(alive AS BIGINT) AS alive, kinds, round(l[1], 6) AS top, round(l[1] - coalesce(l[2], 0), 6) AS margin, round(CASE WHEN kinds > 1 THEN ln(alive) - e / alive ELSE 0 END, 6) AS entropy FROM re JOIN rt USING (symbol, session, run)), rf AS (SELECT *, alive - lag(alive) OVER w AS alive_change, round(margin - lag(margin) OVER w, 6) AS margin_change FROM rf0 WINDOW w AS (PARTITION BY symbol, session ORDER BY run))"


@query(ROUTE + " SELECT * REPLACE (CAST(run AS BIGINT) AS run) FROM rf")
def route_features(spark, d):
    return structure.route_features(_alive(spark, d))


@query(ROUTE + " SELECT symbol, session, CAST(run AS BIGINT) AS run, CASE WHEN entropy >= 0.6 AND margin <= 0.01 THEN 'BROAD_CONFLICT' WHEN alive_change < 0 AND margin_change > 0 THEN 'NARROWING' WHEN top >= 0.7 AND margin >= 0.05 THEN 'DOMINANT_ROUTE' WHEN alive <= 2 THEN 'LOW_ROUTE_SUPPORT' ELSE 'OTHER' END AS route FROM rf")
def route_states(spark, d):
    r = structure.route_features(_alive(spark, d))
    return r.select(*SESSION, "run", structure.route_state(0.6, 0.01, 0.05, 0.7).alias("route"))


@query(DONE + ", t AS (SELECT *, row_number() OVER (PARTITION BY symbol, session, run ORDER BY states, walk) AS k FROM cp), a AS (SELECT symbol, session, run, array_to_string(list_sort(list(DISTINCT walk)), '|') AS \"all\" FROM cp GROUP BY 1, 2, 3) SELECT symbol, session, CAST(run AS BIGINT) AS run, walk AS owner, \"all\" FROM t JOIN a USING (symbol, session, run) WHERE k = 1")
def loop_ties(spark, d):
    return structure.resolve_ties(_done(spark, d))


@query(ORIENT + " SELECT root, kind, count(*) AS n, count(DISTINCT symbol) AS symbols FROM wk WHERE root NOT IN (SELECT walk FROM di) GROUP BY 1, 2")
def unregistered_loops(spark, d):
    return structure.unregistered(structure.closed_walks(bars.hourly(spark, d)), _dictionary(spark, d))


PC = RUNS + ", q AS (SELECT *, lag(state, 1) OVER w AS p1, lag(state, 2) OVER w AS p2, lag(state, 3) OVER w AS p3, lag(state, 4) OVER w AS p4, lag(duration, 1) OVER w AS d1, lag(duration, 2) OVER w AS d2, lead(state) OVER w AS nx FROM r WINDOW w AS (PARTITION BY symbol, session ORDER BY run)), g AS (SELECT *, last_value(CASE WHEN p2 = state THEN {'run': run, 'a': p1, 'z': state} END IGNORE NULLS) OVER (PARTITION BY symbol, session ORDER BY run ROWS UNBOUNDED PRECEDING) AS lc FROM q), pc AS (SELECT symbol, session, CAST(run AS BIGINT) AS run, s AS start, state, p1, p2, p3, p4, d1, d2, CASE WHEN lc IS NULL THEN 'none' ELSE concat_ws('|', least(lc.a, lc.z), greatest(lc.a, lc.z)) END AS last_pair, CAST(coalesce(run - lc.run, -1) AS BIGINT) AS recency, CASE WHEN ending = 'exit' THEN CASE WHEN nx = p1 THEN 1 ELSE 0 END END AS target, CASE WHEN ending = 'exit' THEN 'available' ELSE 'censored_' || ending END AS censoring FROM g WHERE p1 IS NOT NULL)"


@query(PC + " SELECT * FROM pc")
def pair_closures(spark, d):
    return structure.pair_closures(bars.hourly(spark, d))


@query(PC + ", g2 AS (SELECT p1, state, count(*) AS n, sum(target) AS h, count(DISTINCT symbol) AS symbols FROM pc WHERE target IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, (sum(h) OVER (PARTITION BY state) - h) / nullif(sum(n) OVER (PARTITION BY state) - n, 0) AS o FROM g2) SELECT p1, state, n, symbols, round(h / n, 6) AS rate, round(o, 6) AS other_rate, round(h / n - o, 6) AS lift FROM t")
def pair_closure_lift(spark, d):
    return structure.closure_lift(structure.pair_closures(bars.hourly(spark, d)))


IR = "WITH t AS (SELECT user_id, event_id, ts, CASE WHEN value > 450 THEN 'reject' WHEN value > 100 THEN 'hold' ELSE 'accept' END AS p FROM events), x AS (SELECT *, coalesce(max(CASE WHEN p = 'reject' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS gone FROM t)"


@query(IR + " SELECT event_id, CASE WHEN gone THEN 'reject' ELSE p END AS decision, CASE WHEN gone THEN 'prior_rejection_irreversible' ELSE 'proposed_' || p END AS reason FROM x")
def irreversible_decisions(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.when(F.col("value") > 450, "reject").when(F.col("value") > 100, "hold").otherwise("accept").alias("p"))
    return structure.irreversible(e, ["user_id"], ["ts", "event_id"], "p").select("event_id", "decision", "reason")


@query("WITH c AS (SELECT l_orderkey AS k, l_linenumber AS c, sum(l_quantity) AS q, max(l_discount) AS d FROM lineitem GROUP BY 1, 2), p AS (SELECT *, 0.9 * q / sum(q) OVER (PARTITION BY k) AS pr FROM c), w AS (SELECT *, CASE WHEN c <> 3 THEN pr * greatest(sqrt(d + 0.013), 0.05) ELSE 0 END AS w FROM p), t AS (SELECT *, sum(w) OVER (PARTITION BY k) + 0.1 AS t FROM w) SELECT k, c, round(w / t, 5) AS posterior, round(0.1 / t, 5) AS unknown, CASE WHEN c = 3 THEN 'impossible' ELSE 'possible' END AS status FROM t")
def posterior_update(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("c")).agg(F.sum("l_quantity").alias("q"), F.max("l_discount").alias("d"))
    p = c.withColumn("pr", 0.9 * F.col("q") / F.sum("q").over(Window.partitionBy("k")))
    return structure.update_posterior(p, ["k"], "c", "pr", F.col("c") != 3, F.sqrt(F.col("d") + 0.013), F.lit(0.1))


@query("SELECT event_id, value / 500 <= 0.05 AS bottom_5, value / 500 <= 0.1 AS bottom_10, value / 500 <= 0.2 AS bottom_20, value / 500 >= 0.9 AS high_tail, round(value / 500 - 0.1, 6) AS distance FROM events")
def quiet_state(spark, d):
    q = structure.quiet_class(F.col("value") / 500, (0.05, 0.1, 0.2), 0.9)
    return table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in q.items()])


@query(H + ", o AS (SELECT symbol, session, CASE WHEN count(*) = 3 THEN ln(arg_max(close, bar_index) / arg_min(open, bar_index)) END AS r, CASE WHEN count(*) = 3 THEN ln(max(high) / min(low)) END AS g FROM b WHERE bar_index < 3 GROUP BY 1, 2) SELECT symbol, session, CASE WHEN r IS NULL OR g IS NULL THEN 'UNKNOWN_INCOMPLETE' WHEN r <= -0.5 AND g >= 0.8 THEN 'NEGATIVE_SEVERE_OPENING_TRANSITION' WHEN r >= 0.5 AND g >= 0.8 THEN 'POSITIVE_SEVERE_OPENING_TRANSITION' WHEN g >= 0.8 THEN 'ELEVATED_OPENING_RANGE_NONDIRECTIONAL' ELSE 'NORMAL_OPENING' END AS state FROM o")
def opening_transition(spark, d):
    whole = F.count(F.lit(1)) == 3
    o = bars.hourly(spark, d).where("bar_index < 3").groupBy(*SESSION).agg(F.when(whole, log(ratio(F.max_by("close", "bar_index"), F.min_by("open", "bar_index")))).alias("r"), F.when(whole, log(ratio(F.max("high"), F.min("low")))).alias("g"))
    return o.select(*SESSION, structure.opening_transition(F.col("r"), F.col("g"), -0.5, 0.5, 0.8).alias("state"))


SH = H + f", x AS (SELECT symbol, session, bar_index, ln(close / lag(close, 1) {W})) AS a, ln(close / lag(close, 4) {W})) AS z FROM b), y AS (SELECT *, CASE WHEN a >= 0.7 THEN 1 WHEN a <= -0.7 THEN -1 ELSE 0 END AS pa, CASE WHEN z >= 0.7 THEN 1 WHEN z <= -0.7 THEN -1 ELSE 0 END AS pz FROM x)"


@query(SH + " SELECT symbol, session, bar_index, CASE WHEN a IS NULL OR z IS NULL THEN 'UNKNOWN_INCOMPLETE' WHEN pa <> 0 AND pa = pz THEN CASE WHEN pa > 0 THEN 'POSITIVE_PERSISTENT' ELSE 'NEGATIVE_PERSISTENT' END WHEN pa <> 0 AND pz = 0 THEN CASE WHEN pa > 0 THEN 'POSITIVE_FRESH' ELSE 'NEGATIVE_FRESH' END WHEN pa = 0 AND pz <> 0 THEN CASE WHEN pz > 0 THEN 'POSITIVE_FADING' ELSE 'NEGATIVE_FADING' END WHEN pa <> 0 THEN 'REVERSING' ELSE 'NORMAL' END AS state FROM y")
def market_shock_state(spark, d):
    w = ordered(SESSION, ["bar_index"])
    x = bars.hourly(spark, d).select(*SESSION, "bar_index", F.ln(F.col("close") / F.lag("close", 1).over(w)).alias("a"), F.ln(F.col("close") / F.lag("close", 4).over(w)).alias("z"))
    return x.select(*SESSION, "bar_index", structure.shock_state(F.col("a"), F.col("z"), 0.7).alias("state"))


@query(H + f" SELECT symbol, session, bar_index, CAST(sign(close - open) AS INT) AS state, CAST(row_number() {W}) AS INT) AS decision FROM b")
def completed_decisions(spark, d):
    b = bars.hourly(spark, d)
    return structure.completed_decisions(b, events.states(b))


@query(H + ", k AS (SELECT session, c AS checkpoint, symbol, round(sum(close - open), 6) AS total FROM b, (SELECT unnest([3, 9, 15]) AS c) WHERE bar_index <= c GROUP BY ALL) SELECT session, CAST(checkpoint AS INT) AS checkpoint, symbol AS leader, total FROM k QUALIFY row_number() OVER (PARTITION BY session, checkpoint ORDER BY total DESC, symbol) = 1")
def early_leaders(spark, d):
    b = bars.hourly(spark, d).withColumn("move", F.col("close") - F.col("open"))
    return structure.early_leaders(b, ["session"], "symbol", "bar_index", "move", (3, 9, 15))
