"""The guard against what it must refuse, and the tools behind it."""

import pytest
from pyspark.sql import functions as F

from strandline.sources import market_data, sql_gate

BAD = [
    r"select '\'', reflect('java.lang.System','getProperty','user.home') from dataset",
    r"select '\'' from dataset union all select * from parquet.`/etc/x` where a = ''",
    "select * from parquet.`/etc/x`", "select * from other", "select * from default.dataset", "select (select max(a) from other) from dataset", "select a from dataset where a in (select a from other)",
    "with c as (select * from other) select * from c", "with a as (select 1) insert into dataset select * from a", "drop table dataset", "select java_method('java.lang.Runtime', 'x')", "select input_file_name() from dataset", "select transform(a) using 'cat' from dataset",
    "select * from range(5)", "set spark.sql.ansi.enabled = false", "explain select 1", "describe dataset", "cache table dataset", "select current_user()", "select 1; drop table dataset", "create view v as select 1", "show tables", "from dataset insert into x select a",
]
GOOD = ["select a, count(*) as n from dataset group by a having count(*) > 0", "with c as (select a from dataset) select * from c where a > 0 order by a", "select sum(a) over (partition by b) as s from dataset", "select 'drop; --' as x, upper(b) from dataset limit 2", "select case when a > 1 then 'x' else b end as c from dataset", "select t.a from dataset t join dataset u on t.a = u.a", "from dataset select a"]


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame([(i, f"password={i}x", f"k{i}") for i in range(700)], "a int, b string, api_key string")


@pytest.mark.parametrize("sql", BAD)
def test_refused(spark, sql):
    with pytest.raises(ValueError):
        sql_gate.check_plan(spark, sql, frozenset({"dataset"}))


@pytest.mark.parametrize("sql", GOOD)
def test_allowed(spark, rows, sql):
    assert sql_gate.select(spark, sql, {"dataset": rows}).count() <= sql_gate.DEFAULT_LIMIT


def test_limit_and_redaction_are_forced(spark, rows):
    got = sql_gate.select(spark, "select * from dataset order by a", {"dataset": rows}, 10_000).collect()
    assert len(got) == sql_gate.MAX_LIMIT and {r.api_key for r in got} == {"[REDACTED]"} and all(r.b == "password=[REDACTED]" for r in got)
    assert [sql_gate.clamp_limit(x) for x in (None, 0, 7, 9_999)] == [100, 1, 7, 500]


def test_two_queries_do_not_replace_each_other(spark, rows):
    one, two = (sql_gate.select(spark, "select count(*) as n from dataset", {"dataset": t}) for t in (rows, rows.limit(3)))
    assert (one.first().n, two.first().n) == (700, 3)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gate_")]


def test_the_guard_stands_before_the_dataset(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "d"))
    with pytest.raises(ValueError):
        market_data.query_dataset(spark, str(tmp_path / "d"), BAD[0])
    assert market_data.query_dataset(spark, str(tmp_path / "d"), "select max(a) as m").first().m == 699


def test_tools(spark, rows):
    bars = rows.select(F.when(F.col("a") % 2 == 0, "ABC").otherwise("ABC.US").alias("symbol"), F.col("a").alias("timestamp"))
    assert sql_gate.symbol_bars(bars, "abc", F.lit(10), F.lit(20)).count() == 11
    assert [r.a for r in sql_gate.latest_rows(rows, "a", limit=2).collect()] == [699, 698]
    assert sql_gate.fetch(rows, "a", 5).count() == 1 and sql_gate.filtered(rows, {"a": None}, {"a": 690}).count() == 10
    assert sql_gate.describe_table(spark, rows).count() == 3 and sql_gate.list_databases(spark).count() >= 1
