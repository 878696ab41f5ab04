"""Joins with hot groups, size checks and the shared folder."""

import pytest
from pyspark.sql import functions as F

from strandline.llm import repeats, shared


def test_hot_groups_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    monkeypatch.setattr(shared, "HOT_KEYS", 20)
    rows = shared.cut(spark.range(300).select((F.when(F.col("id") < 100, 0).otherwise(F.col("id") % 50)).alias("k"), "id"), "rows")
    groups = shared.cut(rows.groupBy("k").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("m")), "groups")
    for kept in (groups, groups.where("k <> 3"), groups.limit(0)):
        got = sorted(map(tuple, shared.with_group(rows, kept, ["k"], 300).select("k", "id", "least").collect()))
        assert got == sorted(map(tuple, rows.join(kept, "k").select("k", "id", "least").collect()))
    plan = shared.with_group(rows, groups, ["k"], 300)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan


def test_repeats_with_hot_groups(spark, docs, monkeypatch):
    want = sorted(map(str, repeats.deduplicated(docs).collect()))
    monkeypatch.setattr(shared, "HOT_ROWS", 0)
    assert sorted(map(str, repeats.deduplicated(docs).collect())) == want


def test_size_is_measured(spark):
    table = spark.createDataFrame([("x" * 1000, [1, 2])] * 10, "a string, b array<long>")
    assert shared.fits(table) and not shared.fits(table, 10_000) and shared.fits(table.limit(0), 0)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError):
        shared.shared_dir(Session())
