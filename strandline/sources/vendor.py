"""Vendor payloads and requests: screener pages, date ranges in chunks, option records, exact observation dates, universes and settings. What is planned is a few rows on the driver; what is read is a table."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.sources import market_data

#: The longest span that one request may ask for, in days, by bar length; page and offset limits.
MAX_SPAN_DAYS = {"1m": 120, "5m": 600, "1h": 7200}
PAGE_ROWS, MAX_OFFSET = 100, 999

SCREENER = "array<struct<code string, symbol string, name string, exchange string, currency string, sector string, industry string, market_capitalization double, adjusted_close double, avgvol_200d double>>"
_NUMBERS = "strike bid ask midpoint last volatility theoretical delta gamma theta vega rho moneyness underlying_price".split()
_COUNTS = "bid_size ask_size volume open_interest dte".split()
OPTION = "struct<id string, attributes struct<contract string, underlying_symbol string, type string, exp_date string, bid_date string, ask_date string, tradetime string, " + ", ".join(f"{c} string" for c in _NUMBERS + _COUNTS) + ">>"


# screener


def screener_filters(exchange: str | None = None, least: Mapping[str, float | None] | None = None, sectors: Sequence[str] = (), industries: Sequence[str] = ()) -> list[tuple[str, str, object]]:
    """The conjunction that is pushed to the vendor."""
    out: list[tuple[str, str, object]] = [("exchange", "=", exchange)] if exchange else []
    out += [(c, ">=", v) for c, v in (least or {}).items() if v is not None]
    return out + [("sector", "=", s) for s in sectors] + [("industry", "=", s) for s in industries]


def apply_filters(rows: DataFrame, filters: Sequence[tuple[str, str, object]]) -> DataFrame:
    """The same conjunction over a table: pushed to its scan."""
    for c, op, v in filters:
        rows = rows.where(F.col(c) >= F.lit(v) if op == ">=" else F.col(c) == F.lit(v))
    return rows


def normalize_screener(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Screener pages (a JSON array, or an object with one as data) as universe rows; a row without code or symbol is an error."""
    array = F.when(F.ltrim(F.col(column)).startswith("{"), F.get_json_object(column, "$.data")).otherwise(F.col(column))
    page = F.from_json(array, SCREENER)
    r = payloads.select(F.explode(page).alias("r")).select("r.*")
    code = F.coalesce("code", "symbol")
    checked = F.when(F.trim(F.coalesce(code, F.lit(""))) == "", F.raise_error(F.lit("screener row without code or symbol")).cast("string")).otherwise(code)
    return r.select(checked.alias("symbol"), "name", "exchange", "currency", F.lit("stock").alias("instrument_type"), "sector", "industry", "market_capitalization", "adjusted_close", "avgvol_200d")


def fetch_pages(spark: SparkSession, fetch: Callable[[int, int], str], limit: int, most_pages: int) -> DataFrame:
    """Pages by offset until the limit, the page limit or an empty page; the payloads, one row each."""
    if limit < 1 or most_pages < 1:
        raise ValueError("limit and pages must be positive")
    pages, asked = [], 0
    while asked < limit and len(pages) < most_pages:
        size = min(PAGE_ROWS, limit - asked)
        if asked > MAX_OFFSET:
            raise ValueError(f"offset beyond {MAX_OFFSET}")
        payload = fetch(size, asked)
        found = json.loads(payload)
        if not (found.get("data") if isinstance(found, dict) else found):
            break
        pages.append((asked, payload))
        asked += size
    return spark.createDataFrame(pages, "offset int, payload string")


def fetch_screener(spark: SparkSession, fetch: Callable[[int, int], str], limit: int, most_pages: int) -> DataFrame:
    return normalize_screener(fetch_pages(spark, fetch, limit, most_pages)).limit(limit)


# time ranges


def chunk_ranges(ranges: DataFrame, start: str, end: str, interval: str) -> DataFrame:
    """Ranges cut into chunks that one request may ask for, the last one shorter."""
    days = MAX_SPAN_DAYS.get(interval)
    if days is None:
        raise ValueError(f"interval: {interval}")
    step = F.make_dt_interval(days=F.lit(days))
    starts = ranges.where(F.col(start) < F.col(end)).withColumn("chunk_start", F.explode(F.sequence(F.col(start), F.col(end) - F.expr("INTERVAL 1 MICROSECOND"), step)))
    return starts.withColumn("chunk_end", F.least(F.col("chunk_start") + step, F.col(end)))


def store_payloads(payloads: DataFrame, base: str, constants: Mapping[str, str], merge: bool = False, overwrite: bool = False) -> DataFrame:
    """Vendor bars to the store: normalised, checked for issues of error severity, then written; stored rows are only replaced if asked for."""
    from strandline.operators.checks import validate_ohlcv

    spark = payloads.sparkSession
    flat = market_data.normalize_response(payloads)
    rows = flat.select(*[F.lit(v).alias(k) for k, v in constants.items()], *[c for c in flat.columns if c not in constants])
    errors = validate_ohlcv(rows, list(market_data.PARTITIONS), "timestamp").where("severity = 'error'")
    bad = [f"{r.code}: {r.n}" for r in errors.collect()]
    if bad:
        raise ValueError("; ".join(bad))
    try:
        old = market_data.load_dataset(spark, base, **{k: constants[k] for k in market_data.PARTITIONS})
        there = old.limit(1).count() > 0
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = False
    if there and not (merge or overwrite):
        raise ValueError("dataset exists: merge or overwrite")
    if there and merge:
        rows = market_data.upsert(old.select(*rows.columns), rows, [*market_data.PARTITIONS, "timestamp"])
        # the store is read and written: what is merged is kept apart until it is whole
        from strandline.sources.store import checkpoint_root

        staged = f"{checkpoint_root(spark)}/merge-{spark.sparkContext.applicationId}-{abs(hash(tuple(constants.items())))}"
        rows.write.mode("overwrite").parquet(staged)
        rows = spark.read.parquet(staged)
    market_data.write_dataset(rows, base, mode="overwrite" if there else "append")
    return rows


def bounded_source(spark: SparkSession, path: str, start: Column, end: Column, time: str = "timestamp") -> DataFrame:
    """The six bar columns between two times, both included: pushed to the scan."""
    return spark.read.parquet(path).select(time, "open", "high", "low", "close", "volume").where(F.col(time).between(start, end))


# option records


def observation_date(identity: Column) -> Column:
    """The date that a record's id ends with."""
    return F.try_to_timestamp(F.right(identity, F.lit(10)), F.lit("yyyy-MM-dd")).cast("date")


def canonical_records(records: DataFrame, column: str = "payload") -> DataFrame:
    """Option records as canonical contract rows with the reason why one is rejected (null: accepted). The day is that of the record's id, and the days of bid and ask must be the same."""
    r = records.withColumn("__r", F.from_json(column, OPTION))
    a = lambda c: F.col(f"__r.attributes.{c}")
    number = {c: F.nanvl(a(c).try_cast("double"), F.lit(None)) for c in _NUMBERS}
    count = {c: a(c).try_cast("bigint") for c in _COUNTS}
    day = observation_date(F.col("__r.id"))
    quoted = lambda c: F.try_to_timestamp(F.left(a(c), F.lit(10)), F.lit("yyyy-MM-dd")).cast("date")
    out = r.select(
        *[c for c in records.columns if c != column], F.sha2(F.col(column), 256).alias("raw_record_hash"), F.trim(a("contract")).alias("contract_id"), F.trim(a("underlying_symbol")).alias("underlying_symbol"), F.lower(a("type")).alias("option_type"), F.try_to_timestamp(a("exp_date"), F.lit("yyyy-MM-dd")).cast("date").alias("expiration_date"), day.alias("trade_date"), quoted("bid_date").alias("__bid"), quoted("ask_date").alias("__ask"),
        *[number[c].alias(c) for c in _NUMBERS if c != "midpoint"], F.coalesce(number["midpoint"], (number["bid"] + number["ask"]) / 2).alias("midpoint"), *[count[c].alias(c if c != "dte" else "__dte") for c in _COUNTS], *[(a(c).isNotNull() & number[c].isNull()).alias(f"__bad_{c}") for c in ("strike", "bid", "ask")],
    )
    days = F.datediff("expiration_date", "trade_date")
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = (
        F.when(none("contract_id"), "missing_contract_id").when(none("underlying_symbol"), "missing_underlying_symbol").when(~F.coalesce(F.col("option_type").isin("call", "put"), F.lit(False)), "invalid_option_type")
        .when(F.col("__bad_strike") | ~(F.coalesce("strike", F.lit(0.0)) > 0), "invalid_strike").when(F.col("expiration_date").isNull(), "invalid_expiration").when(F.col("trade_date").isNull(), "invalid_observation_date")
        .when(~(F.coalesce(F.col("__bid") == F.col("trade_date"), F.lit(False)) & F.coalesce(F.col("__ask") == F.col("trade_date"), F.lit(False))), "eod_observation_date_mismatch").when(F.col("expiration_date") < F.col("trade_date"), "expiration_before_trade_date")
        .when(F.col("__dte") < 0, "negative_dte").when(F.col("__dte") != days, "contract_date_dte_inconsistency").when(F.col("__bad_bid") | F.col("__bad_ask"), "invalid_number")
    )
    return out.withColumns({"dte": days, "reason": reason}).drop(*[c for c in out.columns if c.startswith("__")])


def resolve_duplicates(records: DataFrame) -> DataFrame:
    """One record for each contract and day: the smallest raw hash; and whether the others said something else."""
    w = Window.partitionBy("contract_id", "trade_date")
    r = records.withColumns({"copies": F.count(F.lit(1)).over(w), "conflict": F.min("raw_record_hash").over(w) != F.max("raw_record_hash").over(w), "__k": F.row_number().over(w.orderBy("raw_record_hash"))})
    return r.where("__k = 1").drop("__k")


def exact_date(records: DataFrame, identity: str, wanted: Column, boundary: Column, complete: bool = True) -> DataFrame:
    """Records of exactly the wanted observation date. Refuses what it cannot date."""
    day = F.coalesce(observation_date(F.col(identity)), F.raise_error(F.lit("record without an observation date")).cast("date"))
    return records.withColumn("observation_date", day).where((F.col("observation_date") == wanted) & (F.col("observation_date") <= boundary) & F.lit(complete))


def exact_date_status(records: DataFrame, by: list[str], identity: str, wanted: Column, boundary: Column, complete: Column) -> DataFrame:
    """What a response holds of a wanted date: how many of it, of others and of days past a boundary, and the status."""
    d = observation_date(F.col(identity))
    g = records.groupBy(*by).agg(F.count_if(d == wanted).alias("exact"), F.count_if(d != wanted).alias("other"), F.count_if((d != wanted) & (d > boundary)).alias("past_boundary"), F.count_if(d.isNull()).alias("undated"), F.bool_and(complete).alias("complete"))
    status = F.when(F.col("undated") > 0, "schema_failure").when(~F.col("complete"), "incomplete_pagination").when(F.col("exact") == 0, "exact_date_absent").when(F.col("other") > 0, "extra_dates_discarded").otherwise("exact_date_complete")
    return g.withColumn("status", status)


@dataclass(frozen=True)
class OptionsRequest:
    """A bounded request; a side that is None is open."""

    symbol: str
    trade_from: date | None = None
    trade_to: date | None = None
    expiry_from: date | None = None
    expiry_to: date | None = None
    strike_from: float | None = None
    strike_to: float | None = None


def split_request(request: OptionsRequest) -> tuple[OptionsRequest, OptionsRequest]:
    """Two halves of a request that is too large: by days, then expiries, then strikes."""
    for kind in ("trade", "expiry"):
        a, b = getattr(request, f"{kind}_from"), getattr(request, f"{kind}_to")
        if a is not None and b is not None and a < b:
            middle = a + timedelta(days=(b - a).days // 2)
            return replace(request, **{f"{kind}_to": middle}), replace(request, **{f"{kind}_from": middle + timedelta(days=1)})
    a, b = request.strike_from, request.strike_to
    if a is not None and b is not None and a < b:
        middle = (a + b) / 2
        above = math.nextafter(middle, math.inf)
        if above <= b:
            return replace(request, strike_to=middle), replace(request, strike_from=above)
    raise ValueError("request cannot be made smaller")


def planned_requests(request: OptionsRequest, rows_of: Callable[[OptionsRequest], int], most: int) -> list[OptionsRequest]:
    """The request, split until each part is small enough."""
    if rows_of(request) <= most:
        return [request]
    return [x for part in split_request(request) for x in planned_requests(part, rows_of, most)]


# settings and universes


@dataclass(frozen=True)
class Hypothesis:
    """A research setting; unknown names are refused."""

    id: str
    template: str
    parameters: dict = field(default_factory=dict)
    timeframe: str = "1d"
    direction: str = "long_only"
    train: int = 250
    test: int = 60
    embargo: int = 0
    cost_bps: float = 5.0

    def __post_init__(self) -> None:
        if not self.id.strip() or self.direction not in ("long_only", "short_only", "long_short") or min(self.train, self.test) <= 0 or self.embargo < 0:
            raise ValueError("invalid hypothesis")


def _settings(text: str) -> dict:
    """JSON, or the flat part of YAML: key: value lines, values as JSON or plain text."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    out = {}
    for line in text.splitlines():
        body = line.split(" #", 1)[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        key, sep, value = body.partition(":")
        if not sep or key != key.strip():
            raise ValueError(f"cannot read: {line!r}")
        try:
            out[key] = json.loads(value)
        except json.JSONDecodeError:
            out[key] = value.strip().strip("'\"")
    return out


def load_hypothesis(text: str) -> Hypothesis:
    return Hypothesis(**_settings(text))


def load_universe(spark: SparkSession, text: str) -> DataFrame:
    """A universe (JSON with id, name and symbols) as one row a symbol."""
    u = json.loads(text)
    rows = [(u["id"], str(s["symbol"] if isinstance(s, dict) else s).upper(), (s.get("sector") if isinstance(s, dict) else None)) for s in u.get("symbols", [])]
    return spark.createDataFrame(rows, "universe string, symbol string, sector string")


def load_research_ready(spark: SparkSession, text: str) -> DataFrame:
    """The qualified symbols of a qualification report."""
    return spark.createDataFrame([(s,) for s in sorted(set(json.loads(text)["qualified_symbols"]))], "symbol string")


def utc(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00"))
