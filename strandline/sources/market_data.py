"""Sources and sinks: CSV import, the partitioned bar store, bounded scans, guarded SQL, vendor payloads."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.sources import sql_gate
from strandline.sources.bars import OPTIONAL, REQUIRED

PARTITIONS = ["source", "instrument_type", "symbol", "timeframe"]
LAYERS = ("raw", "processed", "features", "reports")
#: Header aliases.
ALIASES = {
    "timestamp": ["timestamp", "datetime", "date", "time", "ts"], "open": ["open", "o"], "high": ["high", "h"], "low": ["low", "l"], "close": ["close", "c", "last"],
    "volume": ["volume", "vol", "v"], "bid": ["bid"], "ask": ["ask"], "adjusted_close": ["adjustedclose", "adjclose"],
}


def parse_column_mapping(text: str | None) -> dict[str, str]:
    """`canonical=source,...`"""
    out = {}
    for part in filter(None, (x.strip() for x in (text or "").split(","))):
        name, eq, column = part.partition("=")
        if not eq or not name.strip() or not column.strip():
            raise ValueError(f"not canonical=source: {part!r}")
        out[name.strip()] = column.strip()
    return out


def infer_column_mapping(columns: Sequence[str], explicit: Mapping[str, str] | None = None) -> dict[str, str]:
    """Canonical name to source column; case, blanks, `_` and `-` don't count, and explicit names win."""
    plain = {re.sub(r"[\s_-]", "", c).lower(): c for c in reversed(columns)}
    found = {k: plain[a] for k, names in ALIASES.items() for a in reversed(names) if a in plain}
    return found | dict(explicit or {})


def import_csv(spark: SparkSession, path: str, symbol: str, source: str, timeframe: str, instrument_type: str, currency: str = "USD", timezone: str = "UTC", mapping: Mapping[str, str] | None = None) -> DataFrame:
    """CSV rows as canonical bars: bad numbers are null, times without an offset are read in the given zone, all are UTC."""
    raw = spark.read.csv(path, header=True)
    names = infer_column_mapping(raw.columns, mapping)
    missing = [c for c in ("timestamp", "open", "high", "low", "close") if c not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    text = F.col(f"`{names['timestamp']}`")
    own = F.try_to_timestamp(text)
    ts = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), own).otherwise(F.to_utc_timestamp(own, timezone))
    constants = {"source": source, "symbol": symbol, "instrument_type": instrument_type, "timeframe": timeframe, "currency": currency, "timezone": "UTC"}
    number = lambda c: F.nanvl(F.col(f"`{names[c]}`").try_cast("double"), F.lit(None)) if c in names else F.lit(None).cast("double")
    columns = [F.lit(constants[c]).alias(c) if c in constants else ts.alias(c) if c == "timestamp" else number(c).alias(c) for c in REQUIRED]
    return raw.select(*columns, *[number(c).alias(c) for c in OPTIONAL if c in names])


def write_dataset(bars: DataFrame, base: str, layer: str = "processed", mode: str = "append") -> None:
    """Hive layout by source, instrument type, symbol and timeframe; one sorted file for each, or as many as its rows need."""
    if layer not in LAYERS:
        raise ValueError(f"layer: {layer}")
    bars.repartition(*PARTITIONS).sortWithinPartitions(*PARTITIONS, "timestamp").write.option("partitionOverwriteMode", "dynamic").mode(mode).partitionBy(*PARTITIONS).parquet(f"{base}/{layer}")


def load_dataset(spark: SparkSession, base: str, layer: str = "processed", **key: str) -> DataFrame:
    """The bars of a dataset key: partitions are pruned. Partition values are texts: a timeframe like 1d is not the number that it can be read as."""
    path = f"{base}/{layer}"
    fields = [T.StructField(f.name, T.StringType()) if f.name in PARTITIONS else f for f in spark.read.parquet(path).schema]
    df = spark.read.schema(T.StructType(fields)).parquet(path)
    for name, value in key.items():
        df = df.where(F.col(name) == value)
    return df


def dataset_metadata(bars: DataFrame) -> DataFrame:
    """Rows, first and last time and missing canonical columns for each dataset."""
    missing = [c for c in REQUIRED if c not in bars.columns]
    return bars.groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).withColumn("missing", F.array(*[F.lit(c) for c in missing]).cast("array<string>"))


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Both row sets, of each key the newest: rows of ``new`` after those of ``old``."""
    both = old.withColumn("__rank", F.lit(0)).unionByName(new.withColumn("__rank", F.lit(1)))
    return keep_last(both, keys, ["__rank", *order]).drop("__rank")


def read_window(spark: SparkSession, path: str, columns: Sequence[str], time: str, start, end, most: int) -> DataFrame:
    """A projected scan of a time range (both pushed to Parquet); refuses more rows than ``most``."""
    df = spark.read.parquet(path).where(F.col(time).between(start, end)).select(*columns)
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df


def read_tail(spark: SparkSession, path: str, columns: Sequence[str], time: str, rows: int) -> DataFrame:
    """The last rows by time (a top-k, not a sort)."""
    return spark.read.parquet(path).select(*columns).orderBy(F.desc(time)).limit(rows)


def check_select(sql: str) -> str:
    """A single SELECT (or WITH) without comments and semicolons, by its text; ``sql_gate.check_plan`` then checks what the parser reads."""
    text = sql.strip()
    if not re.match(r"(select|with|from)\b", text, re.I) or not sql_gate.comment_free(text) or re.search(r"\b(insert|read_csv)\b", re.sub(r"'(?:\\.|''|[^'\\])*'", "", text), re.I):
        raise ValueError("only a single SELECT is allowed")
    return text


def query_dataset(spark: SparkSession, path: str, sql: str | None = None) -> DataFrame:
    """Guarded SQL over one Parquet path, visible as ``dataset``; without FROM it is added."""
    text = check_select(sql or "select * from dataset limit 10")
    if not re.search(r"\bfrom\b", text, re.I):
        text += " from dataset"
    return sql_gate.select(spark, text, {"dataset": spark.read.parquet(path)}, sql_gate.MAX_LIMIT)


BAR_JSON = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in [("date", T.StringType()), ("datetime", T.StringType()), ("timestamp", T.LongType()), ("open", T.DoubleType()), ("high", T.DoubleType()), ("low", T.DoubleType()), ("close", T.DoubleType()), ("adjusted_close", T.DoubleType()), ("volume", T.DoubleType())]]))


def normalize_response(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """JSON bar arrays as bars: epoch seconds, date-times or dates; the last row of a time wins."""
    rows = payloads.select(*[c for c in payloads.columns if c != column], F.posexplode(F.from_json(column, BAR_JSON)).alias("at", "r"))
    ts = F.coalesce(F.timestamp_seconds("r.timestamp"), F.try_to_timestamp("r.datetime"), F.try_to_timestamp("r.date"))
    keys = [c for c in payloads.columns if c != column]
    flat = rows.select(*keys, "at", ts.alias("timestamp"), "r.open", "r.high", "r.low", "r.close", "r.adjusted_close", "r.volume")
    return keep_last(flat, [*keys, "timestamp"], ["at"]).drop("at")
