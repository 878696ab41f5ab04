"""Structured Streaming: bars by event time, rows that come again, rows that come too late, and sinks that a repeated batch does not spoil.

A batch writes what it adds, under its own number: mergeable partial bars (first and last by time, extremes, counts), the ids
it has seen, and rows too late to count, set aside with the reason. A batch that runs again replaces its own files, so nothing
counts twice; nothing that earlier batches wrote is written again, so a batch costs what it holds. Readers merge the partials.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.store import checkpoint_root

#: How late a row may be, in seconds behind the newest event of the batches before.
LATE = 2 * 86400


def read_events(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """A file stream of events; times become instants."""
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _written(spark: SparkSession, base: str, epoch: int) -> list[str]:
    """The files of the batches before this one."""
    from strandline.sources.sinks import children

    return [f"{base}/{n}" for n in children(spark, base) if n.startswith("epoch=") and int(n.removeprefix("epoch=")) < epoch]


def batch_writer(root: str, partial: Callable[[DataFrame], DataFrame], late: int = LATE) -> Callable[[DataFrame, int], None]:
    """The sink: sets late rows aside, drops rows that came before, writes the partial aggregate of the rest."""

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = _written(spark, f"{root}/seen", epoch)
        rows = batch.dropDuplicates(["event_id"])
        if before:
            seen = spark.read.parquet(*before)
            limit = seen.agg(F.max("ts").alias("m")).first().m
            limit = None if limit is None else limit.timestamp() - late
            rows = rows.join(seen.select("event_id"), "event_id", "left_anti")
            too_late = F.lit(False) if limit is None else F.col("ts") < F.timestamp_seconds(F.lit(limit))
        else:
            too_late = F.lit(False)
        rows.where(too_late).withColumn("reason", F.lit("behind the newest event")).write.mode("overwrite").parquet(f"{root}/late/epoch={epoch}")
        kept = rows.where(~too_late)
        partial(kept).write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")
        kept.select("event_id", "ts").write.mode("overwrite").parquet(f"{root}/seen/epoch={epoch}")

    return put


def partial_bars(rows: DataFrame) -> DataFrame:
    order = F.struct("ts", "event_id")
    hour = F.date_trunc("hour", "ts")
    return rows.groupBy(F.col("event_type").alias("symbol"), hour.alias("start")).agg(F.min(F.struct(order.alias("o"), F.col("value").alias("v"))).alias("first"), F.max(F.struct(order.alias("o"), F.col("value").alias("v"))).alias("last"), F.max("value").alias("high"), F.min("value").alias("low"), F.count(F.lit(1)).alias("n"))


def merged_bars(partials: DataFrame) -> DataFrame:
    g = partials.groupBy("symbol", "start").agg(F.min("first").alias("f"), F.max("last").alias("l"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("n").cast("double").alias("volume"))
    return g.select("symbol", F.date_format("start", "yyyy-MM-dd").alias("session"), F.hour("start").alias("bar_index"), F.col("f.v").alias("open"), "high", "low", F.col("l.v").alias("close"), "volume")


def partial_flow(rows: DataFrame) -> DataFrame:
    """Sums and the ids of a day's users: sets merge by union, a day's users bound them."""
    return rows.groupBy(F.col("event_type").alias("symbol"), F.unix_timestamp(F.date_trunc("day", "ts")).alias("start")).agg(F.collect_set("user_id").alias("users"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("volume"))


def merged_flow(partials: DataFrame) -> DataFrame:
    g = partials.groupBy("symbol", "start").agg(F.size(F.array_distinct(F.flatten(F.collect_list("users")))).cast("long").alias("users"), F.sum("n").alias("n"), F.round(F.sum("volume"), 4).alias("volume"))
    return g


def run(spark: SparkSession, path: str, schema, root: str, partial: Callable[[DataFrame], DataFrame], files: int | None = None) -> None:
    """Runs a stream over all files that are there now, batch by batch, to the end; the checkpoint lets it go on where it stopped."""
    q = read_events(spark, path, schema, files).writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(batch_writer(root, partial)).start()
    q.awaitTermination()


def _drained(spark: SparkSession, sf_dir: str, partial: Callable[[DataFrame], DataFrame]) -> str:
    source = f"{sf_dir}/events.parquet"
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    # a glob makes the file itself the stream's only entry
    run(spark, source + "*", spark.read.parquet(source).schema, root, partial)
    return root


def drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars that the stream has made of the table's files."""
    return merged_bars(spark.read.parquet(f"{_drained(spark, sf_dir, partial_bars)}/out"))


def drained_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily flow by symbol, as the stream has made it."""
    return merged_flow(spark.read.parquet(f"{_drained(spark, sf_dir, partial_flow)}/out"))


def drained_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows were set aside as late, and how many counted."""
    root = _drained(spark, sf_dir, partial_bars)
    late = spark.read.parquet(f"{root}/late").agg(F.count(F.lit(1)).alias("late"))
    return late.withColumn("__one", F.lit(1)).join(spark.read.parquet(f"{root}/out").agg(F.sum("n").alias("kept")).withColumn("__one", F.lit(1)), "__one").drop("__one")
