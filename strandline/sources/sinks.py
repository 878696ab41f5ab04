"""Sinks: an append-only event store by content, a catalog, reports, deterministic files and frame hashes. Files go through Hadoop's file systems, as Spark's own do, so that a path may be anywhere."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_PARTITIONS = ["source", "kind", "symbol", "session"]
#: The total order of events.
EVENT_ORDER = ["ordering_time", "received_ns", "sequence", "event_id"]


def row_hash(columns: Sequence[str]) -> Column:
    """A digest of a row's values at full precision; null and the empty text differ."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def frame_hash(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A digest of all rows that their order does not change: the sums of two halves of each row's digest, and the number of rows."""
    h = row_hash(columns)
    half = lambda i: F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(30,0)"))
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), half(0).alias("a"), half(1).alias("b"))
    return g.select(*by, "rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("hash"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, first under another name, so that a reader never sees half of it."""
    fs, p = _fs(spark, path)
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.staged")
    out = fs.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(staged, p)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


class EventStore:
    """Immutable events in partitions. A write is a set of rows, known by their digest: written once, under that name, staged
    first and renamed when it is whole; writing the same rows again changes nothing. ``manifest`` has a row for each write."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def write(self, events: DataFrame, complete: bool = True, gaps: int = 0) -> str:
        """Writes all partitions of the events; the name of the write."""
        if gaps < 0:
            raise ValueError("gaps must not be negative")
        columns = sorted(events.columns)
        told = frame_hash(events, columns).first()
        if not told.rows:
            raise ValueError("at least one event is required")
        name = f"write-{told.hash}"
        final, staged = f"{self.base}/data/{name}", f"{self.base}/staged/{name}-{uuid.uuid4().hex}"
        if exists(self.spark, f"{self.base}/manifest/{name}.json"):
            return name
        if not exists(self.spark, final):
            rows = events.repartition(*EVENT_PARTITIONS).sortWithinPartitions(*EVENT_PARTITIONS, *EVENT_ORDER)
            rows.write.option("compression", "zstd").partitionBy(*EVENT_PARTITIONS).parquet(staged)
            fs, to = _fs(self.spark, final)
            fs.mkdirs(to.getParent())
            if not fs.rename(self.spark._jvm.org.apache.hadoop.fs.Path(staged), to):
                raise RuntimeError("the staged write cannot be renamed")
        span = events.agg(F.min("ordering_time").cast("string").alias("a"), F.max("ordering_time").cast("string").alias("b")).first()
        write_text(self.spark, f"{self.base}/manifest/{name}.json", json.dumps({"name": name, "rows": told.rows, "hash": told.hash, "first": span.a, "last": span.b, "complete": complete, "gaps": gaps, "columns": columns}, sort_keys=True))
        return name

    def read(self, name: str | None = None) -> DataFrame:
        """All events whose write is in the manifest, or those of one write; partitions are pruned."""
        names = [name] if name else [r.removesuffix(".json") for r in children(self.spark, f"{self.base}/manifest") if r.endswith(".json")]
        if not names:
            raise ValueError("the store is empty")
        out = None
        for n in names:
            own = self.spark.read.option("basePath", f"{self.base}/data/{n}").parquet(f"{self.base}/data/{n}")
            out = own if out is None else out.unionByName(own)
        return out

    def verify(self, name: str) -> bool:
        """Whether a write holds the rows that its name and its manifest say."""
        told = json.loads(read_text(self.spark, f"{self.base}/manifest/{name}.json"))
        if not exists(self.spark, f"{self.base}/data/{name}"):
            return False
        try:
            found = frame_hash(self.read(name), told["columns"]).first()
        except AnalysisException:  # no file, or none with these columns, is left of it
            return False
        return found.hash == told["hash"] == name.removeprefix("write-") and found.rows == told["rows"]

    def recover(self) -> dict[str, list[str]]:
        """After a crash: staged writes go, whole ones without a manifest are set aside, and so are those whose rows are not what the manifest says."""
        out: dict[str, list[str]] = {"dropped": children(self.spark, f"{self.base}/staged"), "quarantined": []}
        for n in out["dropped"]:
            remove(self.spark, f"{self.base}/staged/{n}")
        told = {r.removesuffix(".json") for r in children(self.spark, f"{self.base}/manifest") if r.endswith(".json")}
        for n in children(self.spark, f"{self.base}/data"):
            if n not in told or not self.verify(n):
                fs, p = _fs(self.spark, f"{self.base}/data/{n}")
                to = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/quarantine/{n}")
                fs.mkdirs(to.getParent())
                fs.rename(p, to)
                remove(self.spark, f"{self.base}/manifest/{n}.json")
                out["quarantined"].append(n)
        return out


def write_catalog(datasets: DataFrame, path: str) -> None:
    """The metadata rows of all datasets as one JSON file (a row a dataset; see market_data.dataset_metadata)."""
    rows = [json.loads(x) for x in datasets.toJSON().collect()]
    write_text(datasets.sparkSession, path, json.dumps(rows, indent=2, sort_keys=True, default=str))


def write_report(spark: SparkSession, base: str, name: str, payload: dict) -> None:
    """A report as JSON and as Markdown beside it."""
    write_text(spark, f"{base}/{name}.json", json.dumps(payload, indent=2, sort_keys=True, default=str))
    lines = [f"# {name}", "", *[f"- {k}: {json.dumps(v, default=str)}" for k, v in sorted(payload.items())]]
    write_text(spark, f"{base}/{name}.md", "\n".join(lines) + "\n")


def audit(bars: DataFrame, by: list[str], time: str) -> dict:
    """Issues, volume, returns and largest moves of a dataset: a few rows each."""
    from strandline.operators import checks, summaries, validation

    found = checks.validate_ohlcv(bars, by, time)
    moves = validation.largest_moves(bars, 3) if {"symbol", "session"} <= set(bars.columns) else None
    told = {"issues": found, "volume": summaries.volume_summary(bars, by), **({"moves": moves, "returns": validation.return_summary(bars)} if moves is not None else {})}
    payload = {k: [r.asDict() for r in v.collect()] for k, v in told.items()}
    return payload | {"passed": not any(r["severity"] == "error" for r in payload["issues"])}


def vendor_qa(raw: DataFrame, stored: DataFrame, key: str, time: str, most_missing: int = 0) -> DataFrame:
    """What the vendor sent against what is stored, by key: rows on one side only, both spans, and whether it should be fetched again."""
    a = raw.select(key, time).distinct().withColumn("__a", F.lit(1))
    j = a.join(stored.select(key, time).distinct().withColumn("__b", F.lit(1)), [key, time], "full_outer")
    g = j.groupBy(key).agg(F.count_if(F.col("__b").isNull()).alias("not_stored"), F.count_if(F.col("__a").isNull()).alias("not_sent"), F.max(F.when(F.col("__a").isNotNull(), F.col(time))).alias("sent_to"), F.max(F.when(F.col("__b").isNotNull(), F.col(time))).alias("stored_to"))
    return g.withColumn("refresh", (F.col("not_stored") > most_missing) | F.coalesce(F.col("stored_to") < F.col("sent_to"), F.lit(True)))


def write_deterministic(rows: DataFrame, path: str, order: Sequence[str], fmt: str = "parquet") -> None:
    """The same rows give the same file contents: one sorted file (small tables: reports and parameters), columns as given."""
    rows.repartition(1).sortWithinPartitions(*order, *[c for c in rows.columns if c not in order]).write.mode("overwrite").options(**({"header": "true"} if fmt == "csv" else {"compression": "zstd"})).format(fmt).save(path)


def write_parameters(spark: SparkSession, path: str, arrays: dict[str, Sequence]) -> None:
    """A bundle of numeric arrays as a table: name, place, value."""
    rows = [(n, i, float(v)) for n, a in sorted(arrays.items()) for i, v in enumerate(a)]
    write_deterministic(spark.createDataFrame(rows, "name string, place int, value double"), path, ["name", "place"])


def read_parameters(spark: SparkSession, path: str) -> dict[str, list[float]]:
    rows = spark.read.parquet(path).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v")).collect()
    return {r.name: [x.value for x in r.v] for r in rows}
