"""The query gateway: guarded SQL over named tables, and small read-only tools over a catalog of tables. The guard reads the parsed plan, not the text."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_LIMIT, MAX_LIMIT = 100, 500
_LOGICAL = "Project Aggregate Filter Sort GlobalLimit LocalLimit Offset Distinct Union Except Intersect Join LateralJoin SubqueryAlias UnresolvedWith UnresolvedHaving OneRowRelation LocalRelation Generate Pivot Unpivot WithWindowDefinition Window Deduplicate AsOfJoin UnresolvedSubqueryColumnAliases UnresolvedInlineTable"
_ALLOWED_NODES = frozenset(_LOGICAL.split())
_FUNCTIONS = """abs acos approx_count_distinct array array_contains array_distinct array_join array_max array_min array_sort ascii asin atan avg between bit_length bool_and bool_or cardinality cast ceil ceiling char_length coalesce collect_list collect_set concat
concat_ws contains corr cos count count_if covar_pop covar_samp cume_dist current_date date date_add date_format date_part date_sub date_trunc datediff day dayofmonth dayofweek dayofyear dense_rank double element_at endswith exists exp explode filter first
first_value flatten float floor from_unixtime get_json_object greatest hash hour if ifnull initcap instr int isnan isnotnull isnull kurtosis lag last last_value lcase lead least left length ln locate log log10 log1p log2 lower lpad ltrim map_keys map_values
max max_by md5 mean median min min_by minute mode mod month named_struct nanvl not nth_value ntile nullif nvl nvl2 percent_rank percentile percentile_approx position posexplode pow power product quarter rank regexp_count regexp_extract regexp_like regexp_replace
regr_intercept regr_slope repeat replace reverse right rlike round row_number rpad rtrim second sequence sha2 sign signum sin size skewness slice sort_array split sqrt startswith std stddev stddev_pop stddev_samp str_to_map string struct substr substring sum tan
timestamp to_date to_json to_timestamp transform trim trunc try_add try_cast try_divide try_element_at try_to_timestamp ucase unix_timestamp upper var_pop var_samp variance weekday weekofyear width_bucket window xxhash64 year zip_with"""
_ALLOWED_FUNCTIONS = frozenset(_FUNCTIONS.split())
_OPERATORS = frozenset("+ - * / % = < > <= >= <=> and or not || in like ilike bigint boolean".split())


def _nodes(value) -> Iterator[dict]:
    """All objects of a plan's JSON, nested ones too."""
    if isinstance(value, dict):
        yield value
        for v in value.values():
            yield from _nodes(v)
    elif isinstance(value, list):
        for v in value:
            yield from _nodes(v)


def check_plan(spark: SparkSession, sql: str, tables: frozenset[str]) -> None:
    """Refuses whatever is not a query over the named tables with allowed functions: commands, inserts, scripts, other tables and files, functions that reach outside. What Spark's own parser reads is what is checked."""
    try:
        plan = json.loads(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toJSON())
    except Exception as e:
        raise ValueError(f"not a query: {str(e).strip().splitlines()[0]}") from None
    nodes = list(_nodes(plan))
    named = {n["_1"].lower() for n in nodes if n.get("product-class", "").startswith("scala.Tuple") and isinstance(n.get("_1"), str)}
    for n in nodes:
        kind = n.get("class", "")
        name = kind.rsplit(".", 1)[-1]
        parts = [x.strip().lower() for x in n.get("multipartIdentifier", n.get("nameParts", "[]")).strip("[]").split(",")] if isinstance(n.get("multipartIdentifier", n.get("nameParts", "")), str) else []
        if name == "UnresolvedRelation":
            if len(parts) != 1 or parts[0] not in tables | named:
                raise ValueError(f"table is not allowed: {'.'.join(parts)}")
        elif name in ("UnresolvedFunction", "UnresolvedGenerator"):
            own = parts or [str(n.get("name", ""))]
            if len(own) != 1 or own[0] not in _ALLOWED_FUNCTIONS | _OPERATORS:
                raise ValueError(f"function is not allowed: {'.'.join(own)}")
        elif name == "UnresolvedTableValuedFunction" or ".logical." in kind and name not in _ALLOWED_NODES or ".command." in kind or ".execution." in kind:
            raise ValueError(f"not allowed in a query: {name}")


def clamp_limit(value: int | None, default: int = DEFAULT_LIMIT, most: int = MAX_LIMIT) -> int:
    return default if value is None else max(1, min(int(value), most))


def redacted(rows: DataFrame) -> DataFrame:
    """String columns without secrets; columns named like credentials are masked whole."""
    from strandline.operators.checks import redact_value

    return redact_value(rows, [f.name for f in rows.schema if isinstance(f.dataType, T.StringType)])


def select(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], limit: int | None = None) -> DataFrame:
    """Guarded SQL over the named tables, with a forced limit and without secrets."""
    check_plan(spark, sql, frozenset(t.lower() for t in tables))
    return redacted(_sql(spark, sql, tables).limit(clamp_limit(limit)))


def _sql(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Runs checked SQL over the tables under names that nobody else has, so that two queries never replace each other's views."""
    own = {name: f"gate_{uuid.uuid4().hex}_{name}" for name in tables}
    for name, rows in tables.items():
        rows.createOrReplaceTempView(own[name])
    with_ = ", ".join(f"`{name}` as (select * from `{view}`)" for name, view in own.items())
    body = re.match(r"\s*with\s+(recursive\s+)?", sql, re.I)
    try:
        return spark.sql(f"with {with_}, {sql[body.end():]}" if body else f"with {with_} {sql}")
    finally:
        for view in own.values():
            spark.catalog.dropTempView(view)


def list_tables(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    return spark.createDataFrame([(n, len(t.columns)) for n, t in sorted(tables.items())], "table string, columns int")


def list_databases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x.name,) for x in spark.catalog.listDatabases()], "name string")


def describe_table(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(rows.schema)], "position int, name string, type string, nullable boolean")


def preview_table(rows: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """The first rows by an order (a top-k), without secrets."""
    return redacted(rows.orderBy(*order).limit(clamp_limit(limit)))


def symbol_bars(bars: DataFrame, symbol: str, start: Column | None = None, end: Column | None = None, limit: int | None = None, time: str = "timestamp") -> DataFrame:
    """Bars of one symbol (as given, or with the market's suffix) between two times, oldest first."""
    rows = bars.where(F.col("symbol").isin(symbol.upper(), f"{symbol.upper()}.US"))
    rows = rows.where(F.col(time) >= start) if start is not None else rows
    rows = rows.where(F.col(time) <= end) if end is not None else rows
    return rows.orderBy(time).limit(clamp_limit(limit, 500))


def latest_rows(rows: DataFrame, time: str, key: str | None = None, value=None, limit: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """The newest rows, of one key if it is given."""
    own = rows.where(F.col(key) == value) if key is not None else rows
    return own.orderBy(F.desc(time), *ties).limit(clamp_limit(limit))


def filtered(rows: DataFrame, equal: Mapping[str, object], least: Mapping[str, float] | None = None, prefix: Mapping[str, str] | None = None) -> DataFrame:
    """Report rows by equal, least and prefix predicates; what is None is not asked for."""
    for c, v in equal.items():
        rows = rows.where(F.col(c).eqNullSafe(F.lit(v))) if v is not None else rows
    for c, v in (least or {}).items():
        rows = rows.where(F.coalesce(F.col(c), F.lit(0)) >= v) if v is not None else rows
    for c, v in (prefix or {}).items():
        rows = rows.where(F.col(c).startswith(v)) if v is not None else rows
    return rows


def search_lines(rows: DataFrame, key: str, text: str, literal: str, limit: int = MAX_LIMIT) -> DataFrame:
    """Lines that hold a literal, with their numbers."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return lines.where(F.contains(F.col("line"), F.lit(literal))).select(key, (F.col("at") + 1).alias("line_number"), "line").orderBy(key, "line_number").limit(limit)


def fetch(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == value)


def signals(episodes: DataFrame, scores: DataFrame, checkpoints: DataFrame, key: str, time: str, limit: int = 200) -> DataFrame:
    """Episodes with their score, if there is one, and the number of their checkpoints, newest first."""
    n = checkpoints.groupBy(key).agg(F.count(F.lit(1)).alias("checkpoint_count"))
    j = episodes.join(scores, key, "left").join(n, key, "left").withColumn("checkpoint_count", F.coalesce("checkpoint_count", F.lit(0)))
    return j.orderBy(F.desc(time), key).limit(limit)


def comment_free(sql: str) -> bool:
    """Whether a text has no comment and no semicolon outside strings, as Spark reads strings (backslashes escape)."""
    plain = re.sub(r"'(?:\\.|''|[^'\\])*'|\"(?:\\.|\"\"|[^\"\\])*\"|`(?:``|[^`])*`", "", sql, flags=re.S)
    return not re.search(r";|--|/\*", plain)
