"""Queries of sources, sinks and the query gateway."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from strandline.plans.registry import H, WD, D, query, table
from strandline.sources import bars, market_data, sinks, sql_gate, vendor


def screen_json(spark, d):
    """Parts as screener pages: one JSON array a brand, every second one inside an object."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.struct(F.concat(F.lit("S"), F.col("p_partkey")).alias("code"), F.col("p_name").alias("name"), F.col("p_brand").alias("exchange"), F.lit("USD").alias("currency"), F.col("p_type").alias("sector"), F.col("p_retailprice").alias("adjusted_close"), F.col("p_size").cast("double").alias("avgvol_200d")).alias("s"))
    g = p.groupBy("brand").agg(F.to_json(F.collect_list("s")).alias("j"))
    return g.select(F.when(F.right("brand", F.lit(1)).isin("2", "4"), F.concat(F.lit('{"data": '), "j", F.lit("}"))).otherwise(F.col("j")).alias("payload"))


@query("SELECT 'S' || p_partkey AS symbol, p_name AS name, p_brand AS exchange, 'USD' AS currency, 'stock' AS instrument_type, p_type AS sector, p_retailprice AS adjusted_close, CAST(p_size AS DOUBLE) AS avgvol_200d FROM part")
def screener_rows(spark, d):
    return vendor.normalize_screener(screen_json(spark, d)).drop("industry", "market_capitalization")


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' AND p_retailprice >= 940 AND p_size >= 10")
def screener_filters(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("exchange"), F.col("p_retailprice").alias("adjusted_close"), F.col("p_size").alias("avgvol_200d"))
    return vendor.apply_filters(p, vendor.screener_filters("Brand#11", {"adjusted_close": 940, "avgvol_200d": 10, "market_capitalization": None})).select("p_partkey")


@query("WITH r AS (SELECT o_orderpriority AS p, min(o_orderdate) AS a, max(o_orderdate) AS z FROM orders GROUP BY 1), c AS (SELECT p, a, z, unnest(generate_series(a, z - INTERVAL 1 MICROSECOND, INTERVAL 600 DAY)) AS chunk_start FROM r) SELECT p, chunk_start, least(chunk_start + INTERVAL 600 DAY, z) AS chunk_end FROM c")
def chunked_ranges(spark, d):
    r = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    return vendor.chunk_ranges(r, "a", "z", "5m").drop("a", "z")


OPT = """WITH o AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_extendedprice AS x, CAST(l_shipdate AS DATE) AS dy, CAST(l_shipdate AS DATE) + l_linenumber * 7 AS ex, CASE WHEN l_suppkey % 20 = 0 THEN NULL ELSE 'C' || l_partkey END AS contract, CASE WHEN l_suppkey % 15 = 1 THEN 'warrant' WHEN l_linenumber % 2 = 0 THEN 'CALL' ELSE 'put' END AS ty, CASE WHEN l_suppkey % 25 = 2 THEN -1.0 ELSE l_quantity END AS strike, CASE WHEN l_suppkey % 11 = 3 THEN CAST(l_shipdate AS DATE) + 1 ELSE CAST(l_shipdate AS DATE) END AS bd, CASE WHEN l_suppkey % 13 = 4 THEN l_linenumber * 7 + 1 END AS dte FROM lineitem)"""


def option_json(spark, d):
    l, day = table(spark, d, "lineitem"), F.to_date("l_shipdate")
    s, n = F.col("l_suppkey"), F.col("l_linenumber")
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    a = F.struct(
        F.when(s % 20 != 0, F.concat(F.lit("C"), F.col("l_partkey"))).alias("contract"), F.lit("U").alias("underlying_symbol"), F.when(s % 15 == 1, "warrant").when(n % 2 == 0, "CALL").otherwise("put").alias("type"), text(F.date_add(day, n * 7)).alias("exp_date"),
        F.concat(text(F.when(s % 11 == 3, F.date_add(day, 1)).otherwise(day)), F.lit(" 15:59:00")).alias("bid_date"), text(day).alias("ask_date"), F.when(s % 25 == 2, -1.0).otherwise(F.col("l_quantity")).cast("string").alias("strike"), F.lit("1.0").alias("bid"), F.lit("2.0").alias("ask"), F.when(s % 13 == 4, n * 7 + 1).cast("string").alias("dte"),
    )
    return l.select(F.col("l_orderkey").alias("k"), n.alias("n"), F.col("l_partkey").alias("p"), F.to_json(F.struct(F.concat(F.lit("C-"), text(day)).alias("id"), a.alias("attributes"))).alias("payload"))


CANON = OPT + ", c AS (SELECT *, CASE WHEN contract IS NULL THEN 'missing_contract_id' WHEN ty = 'warrant' THEN 'invalid_option_type' WHEN strike <= 0 THEN 'invalid_strike' WHEN bd <> dy THEN 'eod_observation_date_mismatch' WHEN dte <> n * 7 THEN 'contract_date_dte_inconsistency' END AS reason FROM o)"


@query(CANON + " SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n, CAST(sum(n * 7) AS BIGINT) AS dte, round(sum(strike), 4) AS strikes, count(DISTINCT contract) AS contracts FROM c GROUP BY 1")
def canonical_options(spark, d):
    c = vendor.canonical_records(option_json(spark, d))
    return c.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("dte").cast("long").alias("dte"), F.round(F.sum("strike"), 4).alias("strikes"), F.count_distinct("contract_id").alias("contracts"))


@query("SELECT o_custkey AS contract_id, CAST(o_orderdate AS DATE) AS trade_date, min(sha256(CAST(o_orderkey AS VARCHAR))) AS raw_record_hash, count(*) AS copies, min(o_orderkey) <> max(o_orderkey) AS conflict FROM orders GROUP BY 1, 2")
def resolve_option_duplicates(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("contract_id"), F.to_date("o_orderdate").alias("trade_date"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("raw_record_hash"))
    return vendor.resolve_duplicates(o)




@query("SELECT o_orderkey, DATE '1996-03-04' AS observation_date FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1996-03-04'")
def exact_observation_date(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("R-"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("id"))
    return vendor.exact_date(o, "id", F.lit(date(1996, 3, 4)), F.lit(date(1998, 1, 1))).drop("id")


@query("WITH r AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, CAST(o_orderdate AS DATE) AS dy, o_orderstatus <> 'P' AS ok FROM orders), g AS (SELECT p, y, count(*) FILTER (WHERE dy = DATE '1996-03-04') AS exact, count(*) FILTER (WHERE dy <> DATE '1996-03-04') AS other, count(*) FILTER (WHERE dy <> DATE '1996-03-04' AND dy > DATE '1998-01-01') AS past_boundary, CAST(0 AS BIGINT) AS undated, bool_and(ok) AS complete FROM r GROUP BY 1, 2) SELECT *, CASE WHEN NOT complete THEN 'incomplete_pagination' WHEN exact = 0 THEN 'exact_date_absent' WHEN other > 0 THEN 'extra_dates_discarded' ELSE 'exact_date_complete' END AS status FROM g")
def exact_date_status(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y"), F.concat(F.lit("R-"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("id"), (F.col("o_orderstatus") != "P").alias("ok"))
    return vendor.exact_date_status(o, ["p", "y"], "id", F.lit(date(1996, 3, 4)), F.lit(date(1998, 1, 1)), F.col("ok"))


@query("SELECT event_type, count(*) AS rows, sum(CAST(('0x' || h[1:12])::UBIGINT AS DECIMAL(30, 0))) AS a, sum(CAST(('0x' || h[13:24])::UBIGINT AS DECIMAL(30, 0))) AS b FROM (SELECT event_type, sha256(concat_ws(chr(31), CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), props)) AS h FROM events) GROUP BY 1".replace("SELECT event_type, count(*) AS rows, sum(", "SELECT event_type, rows, sha256(concat_ws('|', CAST(rows AS VARCHAR), CAST(a AS VARCHAR), CAST(b AS VARCHAR))) AS hash FROM (SELECT event_type, count(*) AS rows, sum(") + ")")
def frame_hash(spark, d):
    return sinks.frame_hash(table(spark, d, "events"), ["event_id", "user_id", "props"], ["event_type"])


def _store(spark, d, name):
    """Customers written to a fresh event store, twice: the second time nothing is written."""
    import uuid

    from strandline.sources.store import checkpoint_root

    c = table(spark, d, "customer")
    e = c.select(F.lit("bank").alias("source"), F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").cast("string").alias("symbol"), F.lit("s1").alias("session"), F.col("c_custkey").alias("event_id"), F.col("c_custkey").alias("sequence"), F.lit(0).cast("long").alias("received_ns"), F.col("c_custkey").alias("ordering_time"), "c_acctbal")
    store = sinks.EventStore(spark, f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}")
    return store, e


@query("SELECT c_mktsegment AS kind, count(*) AS n, round(sum(c_acctbal), 2) AS total, 1 AS writes, true AS sound FROM customer GROUP BY 1")
def event_store(spark, d):
    store, e = _store(spark, d, "events")
    name = store.write(e)
    again = store.write(e)
    writes = len(sinks.children(spark, f"{store.base}/manifest"))
    return store.read().groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.lit(writes).alias("writes"), F.lit(store.verify(name) and name == again).alias("sound"))


@query("SELECT c_mktsegment AS kind, count(*) AS n, 1 AS dropped, 2 AS quarantined FROM customer WHERE c_acctbal < 0 GROUP BY 1")
def recovered_store(spark, d):
    """Three writes, of which one lost its manifest and one some rows, and a staged one that never finished: only the whole one is left."""
    store, e = _store(spark, d, "crash")
    sound = store.write(e.where("c_acctbal < 0"))
    lost, torn = store.write(e.where("c_acctbal >= 5000")), store.write(e.where("c_acctbal between 0 and 4999"))
    sinks.remove(spark, f"{store.base}/manifest/{lost}.json")
    sinks.remove(spark, f"{store.base}/data/{torn}/{next(n for n in sinks.children(spark, f'{store.base}/data/{torn}') if '=' in n)}")
    e.where("c_acctbal < 0").write.parquet(f"{store.base}/staged/{sound}-half")
    told = store.recover()
    return store.read().groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.lit(len(told["dropped"])).alias("dropped"), F.lit(len(told["quarantined"])).alias("quarantined"))


@query(D + " SELECT CAST(session AS TIMESTAMP) AS timestamp, symbol, open, high, low, CASE WHEN volume > 1 THEN close END AS close, volume, 'USD' AS currency FROM b WHERE symbol = '2-HIGH'")
def imported_csv(spark, d):
    """Bars written as CSV under other names and with words for numbers, then imported."""
    import uuid

    from strandline.sources.store import checkpoint_root

    b = bars.daily(spark, d).where("symbol = '2-HIGH'")
    path = f"{checkpoint_root(spark)}/csv-{uuid.uuid4().hex}"
    b.select(F.concat("session", F.lit("T00:00:00Z")).alias("Date Time"), F.col("open").alias("O"), F.col("high").alias("H"), F.col("low").alias("L"), F.when(F.col("volume") > 1, F.col("close").cast("string")).otherwise("n/a").alias("Close"), F.col("volume").alias("Vol")).write.csv(path, header=True)
    mapping = market_data.parse_column_mapping("timestamp=Date Time,open=O,high=H,low=L,volume=Vol")
    return market_data.import_csv(spark, path, "2-HIGH", "orders", "1d", "index", mapping=mapping).select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "symbol", "open", "high", "low", "close", "volume", "currency")


def _vendor(spark, d, name, time):
    """Daily bars as one JSON array a symbol, each bar twice: the first of a pair has another close."""
    b = bars.daily(spark, d)
    bar = lambda k, close: F.struct("session", F.lit(k).alias("k"), F.struct(time.alias(name), "open", "high", "low", close.alias("close"), close.alias("adjusted_close"), "volume").alias("r"))
    g = b.select("symbol", F.explode(F.array(bar(0, F.col("close") + 1), bar(1, F.col("close")))).alias("x")).groupBy("symbol").agg(F.array_sort(F.collect_list("x")).alias("l"))
    return g.select("symbol", F.to_json(F.transform("l", lambda x: x["r"])).alias("payload"))


@query(D + " SELECT symbol, CAST(session AS TIMESTAMP) AS timestamp, close, adjusted_close, volume FROM (SELECT *, close AS adjusted_close FROM b)")
def vendor_daily(spark, d):
    out = market_data.normalize_response(_vendor(spark, d, "date", F.col("session")))
    return out.select("symbol", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "close", "adjusted_close", "volume")


@query(D + " SELECT symbol, CAST(session AS TIMESTAMP) AS timestamp, high, close FROM b")
def vendor_intraday(spark, d):
    out = market_data.normalize_response(_vendor(spark, d, "timestamp", F.unix_timestamp(F.to_timestamp("session"))))
    return out.select("symbol", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "high", "close")


@query("SELECT o_orderkey, CASE WHEN bid IS NULL THEN 'missing' WHEN bid <= 0 THEN 'non_positive' WHEN bid > ask THEN 'crossed' WHEN (ask - bid) / ((bid + ask) / 2) > 0.5 THEN 'wide' END AS reason FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 11 + 0.0::DOUBLE END AS bid, 2 + o_orderkey % 13 + 0.0::DOUBLE AS ask FROM orders)")
def quote_reason(spark, d):
    from strandline.operators import options

    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k, F.when(k % 7 != 0, (k % 11).cast("double")).alias("bid"), (2 + k % 13).cast("double").alias("ask"))
    return o.select("o_orderkey", options.quote_reason(F.col("bid"), F.col("ask")).alias("reason"))


@query("SELECT o_orderpriority AS symbol, count(*) AS n, max(o_totalprice) AS price FROM orders GROUP BY 1")
def deterministic_files(spark, d):
    import uuid

    from strandline.sources.store import checkpoint_root

    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("symbol")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("price"))
    path = f"{checkpoint_root(spark)}/files-{uuid.uuid4().hex}"
    sinks.write_deterministic(g, path, ["symbol"])
    return spark.read.parquet(path)


@query("WITH raw AS (SELECT o_orderpriority AS k, CAST(o_orderdate AS DATE) AS t FROM orders), st AS (SELECT k, t FROM raw WHERE t < DATE '2001-06-01'), j AS (SELECT coalesce(a.k, b.k) AS k, a.t AS ta, b.t AS tb FROM (SELECT DISTINCT * FROM raw) a FULL JOIN (SELECT DISTINCT * FROM st) b ON a.k = b.k AND a.t = b.t) SELECT k, count(*) FILTER (WHERE tb IS NULL) AS not_stored, count(*) FILTER (WHERE ta IS NULL) AS not_sent, max(ta) AS sent_to, max(tb) AS stored_to, count(*) FILTER (WHERE tb IS NULL) > 3 OR coalesce(max(tb) < max(ta), true) AS refresh FROM j GROUP BY 1")
def vendor_qa(spark, d):
    raw = table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), F.to_date("o_orderdate").alias("t"))
    return sinks.vendor_qa(raw, raw.where(F.col("t") < F.lit(date(2001, 6, 1))), "k", "t", 3)




@query(D + " SELECT 'orders' AS source, 'index' AS instrument_type, symbol, '1d' AS timeframe, count(*) AS rows, min(CAST(session AS TIMESTAMP)) AS first, max(CAST(session AS TIMESTAMP)) AS last FROM b GROUP BY ALL")
def dataset_catalog(spark, d):
    """Bars written to the partitioned store and described from it."""
    import uuid

    from strandline.sources.store import checkpoint_root

    b = bars.daily(spark, d).select(F.lit("orders").alias("source"), F.lit("index").alias("instrument_type"), "symbol", F.lit("1d").alias("timeframe"), F.to_timestamp_ntz(F.col("session")).alias("timestamp"), "open", "high", "low", "close", "volume")
    base = f"{checkpoint_root(spark)}/store-{uuid.uuid4().hex}"
    market_data.write_dataset(b, base)
    m = market_data.dataset_metadata(market_data.load_dataset(spark, base))
    sinks.write_catalog(m, f"{base}/catalog.json")
    return m.drop("missing")


@query(D + " SELECT session AS timestamp, close FROM b WHERE symbol = '2-HIGH' AND session BETWEEN '1996-01-01' AND '1996-12-31' ORDER BY session LIMIT 50")
def symbol_bars(spark, d):
    b = bars.daily(spark, d).withColumn("timestamp", F.col("session"))
    return sql_gate.symbol_bars(b, "2-high", F.lit("1996-01-01"), F.lit("1996-12-31"), 50).select("timestamp", "close")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 40")
def latest_rows(spark, d):
    return sql_gate.latest_rows(table(spark, d, "orders"), "o_orderdate", "o_orderpriority", "1-URGENT", 40, ("o_orderkey",)).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 300000 AND starts_with(o_orderpriority, '1')")
def filtered_results(spark, d):
    return sql_gate.filtered(table(spark, d, "orders"), {"o_orderstatus": "F", "o_custkey": None}, {"o_totalprice": 300000}, {"o_orderpriority": "1"}).select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 100")
def preview_table(spark, d):
    return sql_gate.preview_table(table(spark, d, "customer"), ["c_acctbal", "c_custkey"], 100).select("c_custkey", "c_name")


@query("SELECT * FROM (VALUES (0, 'r_regionkey', 'int'), (1, 'r_name', 'string')) t(position, name, type)")
def describe_table(spark, d):
    return sql_gate.describe_table(spark, table(spark, d, "region")).select("position", "name", "type")


@query("SELECT * FROM (VALUES ('customer', 5), ('nation', 3), ('region', 2)) t(\"table\", columns)")
def list_tables(spark, d):
    return sql_gate.list_tables(spark, {t: table(spark, d, t) for t in ("region", "nation", "customer")})


@query("SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_totalprice > 100000 GROUP BY 1 ORDER BY 1 LIMIT 100")
def gate_select(spark, d):
    tables = {"orders": table(spark, d, "orders"), "customer": table(spark, d, "customer")}
    return sql_gate.select(spark, "with big as (select * from orders where o_totalprice > 100000) select o_orderstatus, count(*) as n, round(avg(o_totalprice), 4) as mean from big group by o_orderstatus order by o_orderstatus", tables)


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents) SELECT doc_id, CAST(line_number AS INT) AS line_number, line FROM l WHERE contains(line, 'token') ORDER BY doc_id, line_number LIMIT 200")
def search_lines(spark, d):
    return sql_gate.search_lines(table(spark, d, "documents"), "doc_id", "text", "token", 200)


@query("SELECT * FROM region WHERE r_name = 'ASIA'")
def fetch_row(spark, d):
    return sql_gate.fetch(table(spark, d, "region"), "r_name", "ASIA")


@query("SELECT o_orderkey, c.c_acctbal AS score, coalesce(n, 0) AS checkpoint_count FROM orders o LEFT JOIN (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def recorded_signals(spark, d):
    o = table(spark, d, "orders")
    scores = o.join(table(spark, d, "customer").where("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", F.col("c_acctbal").alias("score"))
    points = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return sql_gate.signals(o.select("o_orderkey", "o_orderdate"), scores, points, "o_orderkey", "o_orderdate", 200).select("o_orderkey", "score", "checkpoint_count")


@query("SELECT symbol, session, open, high, low, close, volume FROM (" + D + " SELECT * FROM b) WHERE session BETWEEN '1997-01-01' AND '1997-12-31'")
def bounded_source(spark, d):
    import uuid

    from strandline.sources.store import checkpoint_root

    path = f"{checkpoint_root(spark)}/bounded-{uuid.uuid4().hex}"
    bars.daily(spark, d).write.partitionBy("symbol").parquet(path)
    parts = [vendor.bounded_source(spark, f"{path}/symbol={s.symbol}", F.lit("1997-01-01"), F.lit("1997-12-31"), "session").select(F.lit(s.symbol).alias("symbol"), "*") for s in spark.read.parquet(path).select("symbol").distinct().collect()]
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), parts)


@query(H + f", s AS (SELECT symbol, session, max(high) AS high, min(low) AS low, arg_min(open, bar_index) AS open, arg_max(close, bar_index) AS close, sum(volume) AS volume FROM b GROUP BY 1, 2), m AS (SELECT *, abs(close / lag(close) {WD}) - 1) AS mv FROM s) SELECT symbol, count(*) FILTER (WHERE mv > 0.2) AS jumps FROM m GROUP BY 1")
def audit_report(spark, d):
    """The issues of an audit that is written as a report and read back."""
    import json
    import uuid

    from strandline.sources.store import checkpoint_root

    b = bars.hourly(spark, d).groupBy("symbol", "session").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.min_by("open", "bar_index").alias("open"), F.max_by("close", "bar_index").alias("close"), F.sum("volume").alias("volume"))
    base = f"{checkpoint_root(spark)}/audit-{uuid.uuid4().hex}"
    sinks.write_report(spark, base, "audit", sinks.audit(b, ["symbol"], "session"))
    told = json.loads(sinks.read_text(spark, f"{base}/audit.json"))
    jumps = {r["symbol"]: r["n"] for r in told["issues"] if r["code"] == "large_price_jump"}
    return spark.createDataFrame([(r["symbol"], jumps.get(r["symbol"], 0)) for r in told["volume"]], "symbol string, jumps long")


