"""The bar stream over several batches: rows that come again, rows too late, a batch that runs twice."""

import datetime

from pyspark.sql import functions as F

from strandline.streaming import stream_bars as streams


def events(spark, rows):
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, start + datetime.timedelta(hours=h), k, float(v)) for i, h, k, v in rows], "event_id long, ts timestamp, event_type string, value double")


def test_batches(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "run")
    parts = [
        [(1, 0.1, "a", 5), (2, 0.5, "a", 9), (3, 70, "b", 1)],
        [(2, 0.5, "a", 9), (4, 0.9, "a", 2), (5, 71, "b", 4), (6, 24, "a", 7)],  # again: 2; 4 is more than two days behind
        [(7, 70.5, "b", 3), (3, 70, "b", 1), (8, 0.2, "a", 100)],
    ]
    schema = events(spark, parts[0]).schema
    for n, rows in enumerate(parts):
        events(spark, rows).coalesce(1).write.mode("append").parquet(source)
        streams.run(spark, source, schema, root, streams.partial_bars, files=1)
        got = {(r.symbol, r.session, r.bar_index): (r.open, r.high, r.low, r.close, r.volume) for r in streams.merged_bars(spark.read.parquet(f"{root}/out")).collect()}
        assert got[("a", "2024-01-01", 0)] == (5, 9, 5, 9, 2)
        assert got[("b", "2024-01-03", 22)] == ((1, 1, 1, 1, 1) if n < 2 else (1, 3, 1, 3, 2))
    late = sorted(r.event_id for r in spark.read.parquet(f"{root}/late").collect())
    assert late == [4, 8] and ("a", "2024-01-02", 0) in got
    # a batch that runs once more replaces what it wrote
    again = streams.batch_writer(root, streams.partial_bars)
    again(events(spark, parts[2]), 2)
    assert {(r.symbol, r.session, r.bar_index): (r.open, r.high, r.low, r.close, r.volume) for r in streams.merged_bars(spark.read.parquet(f"{root}/out")).collect()} == got


def test_flow_merges_sets(spark):
    e = events(spark, [(i, 0.1 * i, "a", 1) for i in range(20)]).withColumn("user_id", F.col("event_id") % 3)
    parts = streams.partial_flow(e.where("event_id < 9")).unionByName(streams.partial_flow(e.where("event_id >= 9")))
    assert [(r.users, r.n) for r in streams.merged_flow(parts).collect()] == [(3, 20)]
