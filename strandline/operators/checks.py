"""Leakage checks, issue tables over bars, session integrity, universe and bar assessment. Issues are rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.windows import islands, ordered


def issues(rows: DataFrame, keys: list[str], code: str, severity: str = "error", message: Column | str = "") -> DataFrame:
    """One issue for each row: keys, code, severity, message."""
    return rows.select(*keys, F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def union(*parts: DataFrame) -> DataFrame:
    """All issues once."""
    return reduce(DataFrame.unionByName, parts).dropDuplicates()


# leakage


def same_bar_close(strategies: DataFrame, keys: list[str], uses_close: Column, lag: Column) -> DataFrame:
    """A signal that uses the close and is executed on the same bar."""
    return issues(strategies.where(uses_close & (lag <= 0)), keys, "same_bar_close")


def feature_target_overlap(models: DataFrame, keys: list[str], features: str, targets: str) -> DataFrame:
    """Targets among the features (error), and features named after the future (warning)."""
    both = F.array_join(F.array_sort(F.array_intersect(features, targets)), ", ")
    later = F.array_join(F.array_sort(F.filter(features, lambda x: F.lower(x).contains("future"))), ", ")
    m = models.select(*keys, both.alias("__both"), later.alias("__later"))
    return issues(m.where("__both <> ''"), keys, "target_in_features", "error", F.col("__both")).unionByName(issues(m.where("__later <> ''"), keys, "future_feature_name", "warning", F.col("__later")))


def train_test_overlap(splits: DataFrame, keys: list[str]) -> DataFrame:
    return issues(splits.where("train_end > test_start"), keys, "train_test_overlap")


def embargo_violation(splits: DataFrame, keys: list[str], embargo: int) -> DataFrame:
    gap = F.col("test_start") - F.col("train_end")
    return issues(splits.where(gap < embargo), keys, "embargo_violation", "error", F.concat(gap.cast("string"), F.lit(f" < {embargo}")))


def timestamp_integrity(rows: DataFrame, by: list[str], time: str, arrival: str) -> DataFrame:
    """Duplicate times, and times that go back in the order of arrival; one pass over each group."""
    r = rows.select(*by, F.col(time).alias("__t"), (F.lag(time).over(ordered(by, [arrival])) > F.col(time)).alias("__back"))
    g = r.groupBy(*by).agg(F.count("__t").alias("n"), F.count_distinct("__t").alias("u"), F.coalesce(F.bool_or("__back"), F.lit(False)).alias("back"))
    return issues(g.where("n > u"), by, "duplicate_timestamps").unionByName(issues(g.where("back"), by, "non_monotonic_timestamps"))


def signal_quality(signals: DataFrame, by: list[str], signal: str, most_null: float = 0.25) -> DataFrame:
    g = signals.groupBy(*by).agg(F.avg(F.col(signal).isNull().cast("double")).alias("nulls"))
    return issues(g.where(F.col("nulls") > most_null), by, "nan_heavy_signal", "error", F.format_number("nulls", 3))


def perfect_prediction(signals: DataFrame, by: list[str], signal: str, target: str, threshold: float = 0.995) -> DataFrame:
    """A correlation with the target that is too good; at least three pairs, neither side constant."""
    pairs = signals.where(F.col(signal).isNotNull() & F.col(target).isNotNull())
    varied = (F.count(F.lit(1)) >= 3) & (F.min(signal) < F.max(signal)) & (F.min(target) < F.max(target))
    g = pairs.groupBy(*by).agg(F.when(varied, F.corr(signal, target)).alias("r"))
    return issues(g.where(F.abs("r") >= threshold), by, "suspicious_perfect_prediction", "warning")


def future_timestamps(rows: DataFrame, by: list[str], feature_time: str, prediction_time: str) -> DataFrame:
    """A feature stamped after the prediction that it serves: one issue for each group."""
    return issues(rows.where(F.col(feature_time) > F.col(prediction_time)).select(*by).distinct(), by, "future_timestamp")


def denied_features(features: DataFrame, name: str, words: list[str]) -> DataFrame:
    """Feature names that a model must not have."""
    return features.where(reduce(Column.__or__, [F.lower(name).contains(w) for w in words]))


def protected_boundary(rows: DataFrame, by: list[str], time: str, cutoff: Column) -> DataFrame:
    """Groups with rows at or after a boundary that must not be read, and the latest of them."""
    return rows.groupBy(*by).agg(F.max(time).alias("latest"), F.count_if(F.col(time) >= cutoff).alias("rows_past")).where("rows_past > 0")


# issue tables over bars


def counted(rows: DataFrame, by: list[str], code: str, severity: str, time: str) -> DataFrame:
    """Rows that fail a check, as one issue for each group: how many, first and last time."""
    return rows.groupBy(*by).agg(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.count(F.lit(1)).alias("n"), F.min(time).cast("string").alias("first"), F.max(time).cast("string").alias("last"))


def unparsed_times(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """How many times cannot be read, and how many of the others say no zone."""
    own = F.try_to_timestamp(F.col(text))
    zoned = F.col(text).rlike(r"(Z|[+-]\d\d:?\d\d)$")
    return rows.groupBy(*by).agg(F.count_if(own.isNull()).alias("invalid_timestamp"), F.count_if(own.isNotNull() & ~zoned).alias("timezone_naive"), F.bool_and(own.isNotNull() & zoned).alias("all_aware"))


def disordered(rows: DataFrame, by: list[str], time: str, arrival: str) -> DataFrame:
    """Rows whose time is before that of the row that arrived before them."""
    return rows.withColumn("__last", F.lag(time).over(ordered(by, [arrival]))).where(F.col("__last") > F.col(time)).drop("__last")


def validate_ohlcv(bars: DataFrame, by: list[str], time: str, jump: float = 0.2, zero_run: int = 3) -> DataFrame:
    """Every check of a bar table as issues by group: duplicates (all members), containment, non-positive cells, negative volume, the longest run without volume, and jumps."""
    price = ["open", "high", "low", "close"]
    same = Window.partitionBy(*by, time)
    w = ordered(by, [time])
    zero = F.coalesce(F.col("volume") == 0, F.lit(False))
    b = bars.withColumns({
        "__same": F.count(F.lit(1)).over(same),
        "__bad": (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high")),
        "__cells": sum(F.coalesce(F.col(c) <= 0, F.lit(False)).cast("int") for c in price),
        "__move": F.abs(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1),
        "__zero": zero,
        "__last": F.lag(zero).over(w),
    })
    b = b.withColumn("__run", islands(F.col("__zero") != F.col("__last"), by, [time]))
    runs = b.where("__zero").groupBy(*by, "__run").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    longest = runs.groupBy(*by).agg(F.lit("zero_volume_run").alias("code"), F.lit("warning").alias("severity"), F.max("n").alias("n"), F.min("first").cast("string").alias("first"), F.max("last").cast("string").alias("last")).where(F.col("n") >= zero_run)
    return reduce(DataFrame.unionByName, [
        counted(b.where("__same > 1"), by, "duplicate_timestamp", "error", time),
        counted(b.where("__bad"), by, "ohlc_inconsistent", "error", time),
        b.where("__cells > 0").groupBy(*by).agg(F.lit("non_positive_price").alias("code"), F.lit("error").alias("severity"), F.sum("__cells").cast("long").alias("n"), F.min(time).cast("string").alias("first"), F.max(time).cast("string").alias("last")),
        counted(b.where("volume < 0"), by, "negative_volume", "error", time),
        longest,
        counted(b.where(F.col("__move") > jump), by, "large_price_jump", "warning", time),
    ])


def missing_sessions(bars: DataFrame, by: str, session: str, calendar: DataFrame) -> DataFrame:
    """Sessions of the calendar inside a group's span that the group has not: the calendar is dealt to the spans, then the observed ones go."""
    seen = bars.select(by, F.col(session).alias("session")).distinct()
    span = seen.groupBy(by).agg(F.min("session").alias("__a"), F.max("session").alias("__b"))
    expected = calendar.select("session").join(F.broadcast(span), F.col("session").between(F.col("__a"), F.col("__b"))).select(by, "session")
    return expected.join(seen, [by, "session"], "left_anti")


def weekdays(bars: DataFrame, session: str) -> DataFrame:
    """The calendar of all weekdays in a table's span; a market's own holidays are a table to take away."""
    days = bars.agg(F.min(F.to_date(session)).alias("a"), F.max(F.to_date(session)).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.where(F.weekday("day") < 5).select(F.date_format("day", "yyyy-MM-dd").alias("session"))


def session_integrity(bars: DataFrame, first: int, last: int) -> DataFrame:
    """Per symbol and session, against the grid first..last (both inclusive): bars missing at the open, in the middle and at the close, extra bars, how times are stamped, and the bucket with its severity."""
    g = bars.groupBy("symbol", "session").agg(F.array_sort(F.collect_set("bar_index")).alias("have"))
    grid = F.sequence(F.lit(first), F.lit(last))
    edge = Window.partitionBy("symbol")
    g = g.select("symbol", "session", "have", F.array_except(grid, F.col("have")).alias("missing"), F.array_except(F.col("have"), grid).alias("extra"), F.array_min("have").alias("a"), F.array_max("have").alias("b"), (F.col("session") == F.min("session").over(edge)).alias("is_first"), (F.col("session") == F.max("session").over(edge)).alias("is_last"))
    at_open, at_close = F.array_contains("missing", first), F.array_contains("missing", last)
    middle = F.exists("missing", lambda x: (x > F.col("a")) & (x < F.col("b")))
    convention = F.when((F.col("a") == first) & (F.col("b") == last), "boundary_inclusive").when((F.col("a") == first) & (F.col("b") == last - 1), "bar_open").when((F.col("a") == first + 1) & (F.col("b") == last), "bar_close").otherwise("partial_or_mixed")
    g = g.select("symbol", "session", F.size("have").alias("bars"), F.size("missing").alias("missing_bars"), F.size("extra").alias("extra_bars"), at_open.alias("missing_open"), middle.alias("missing_middle"), at_close.alias("missing_close"), convention.alias("convention"), "is_first", "is_last")
    bucket = (
        F.when(F.col("extra_bars") > 0, "session_calendar_mismatch")
        .when(F.col("missing_bars") == 0, "complete")
        .when((F.col("is_first") | F.col("is_last")) & (F.col("missing_bars") > 1) & ~F.col("missing_middle"), "expected_fetch_boundary_partial")
        .when(F.col("missing_middle"), "possible_mid_session_gap")
        .when(F.col("missing_open") & ~F.col("missing_close"), "possible_missing_open_bar")
        .when(F.col("missing_close") & ~F.col("missing_open"), "possible_missing_close_bar")
        .when(F.col("missing_open") & F.col("missing_close"), "possible_mid_session_gap")
        .otherwise("unknown")
    )
    return g.withColumn("bucket", bucket).withColumn("severity", F.when(F.col("bucket").isin("complete", "expected_fetch_boundary_partial"), "info").otherwise("warning")).drop("is_first", "is_last")


def expected_times(sessions: DataFrame, open_: str, close: str, minutes: int) -> DataFrame:
    """The grid of a session's times, both ends included."""
    return sessions.withColumn("timestamp", F.explode(F.sequence(F.col(open_), F.col(close), F.make_dt_interval(mins=F.lit(minutes)))))


def validate_universe(symbols: DataFrame, symbol: str, price: str, volume: str) -> DataFrame:
    """Issues of a universe: symbols twice, not in capitals or malformed, prices not above zero, negative volumes."""
    s = symbols.withColumnRenamed(symbol, "symbol")
    again = s.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return reduce(DataFrame.unionByName, [
        issues(again, ["symbol"], "duplicate_symbol", "error", F.concat(F.lit("appears "), F.col("n").cast("string"))),
        issues(s.where(F.trim("symbol") == ""), ["symbol"], "missing_symbol"),
        issues(s.where(F.col("symbol") != F.upper("symbol")), ["symbol"], "symbol_not_uppercase"),
        issues(s.where(F.col(price) <= 0), ["symbol"], "non_positive_adjusted_close", "warning"),
        issues(s.where(F.col(volume) < 0), ["symbol"], "negative_avgvol", "warning"),
    ])


def bar_rejection(most_age: Column, semantics_allowed: Column) -> Column:
    """The first rule that a completed bar fails as a feature source, or null. Columns: complete, minutes, regular, open, high, low, close, activity, received, source, as_of, checkpoint."""
    c = F.col
    empty = c("open").isNull() | c("high").isNull() | c("low").isNull() | c("close").isNull() | c("activity").isNull()
    return (
        F.when(~c("complete"), "partial_bar")
        .when(c("minutes") != 5, "non_five_minute_bar")
        .when(~c("regular"), "outside_frozen_regular_session")
        .when(empty, "missing_required_bar_value")
        .when((c("received") > c("checkpoint")) | (c("source") > c("checkpoint")) | (c("as_of") > c("checkpoint")), "callback_received_after_scoring_checkpoint")
        .when(c("checkpoint") - c("as_of") > most_age, "stale_feature")
        .when(~semantics_allowed, "blocked_feature_source_semantics_mismatch")
        .when((c("high") < F.greatest("open", "close", "low")) | (c("low") > F.least("open", "close", "high")), "invalid_ohlc")
    )


def quote_flags(bid: Column, ask: Column, bid_size: Column, ask_size: Column, age: Column, most_age: Column, live: Column, most_spread: float = 1.0) -> Column:
    """All quality flags of a quote, in a fixed order."""
    mid = (bid + ask) / 2
    return F.array_compact(F.array(
        F.when(bid.isNull(), "missing_bid"), F.when(ask.isNull(), "missing_ask"), F.when(bid == 0, "zero_bid"), F.when(bid > ask, "crossed_quote"), F.when(bid == ask, "locked_quote"),
        F.when(F.abs(age) > most_age, "stale_quote"), F.when((mid > 0) & ((ask - bid) > most_spread * mid), "spread_too_wide"), F.when(bid_size.isNull() | ask_size.isNull(), "size_missing"), F.when(~live, "market_data_not_live"),
    ))


def redact_value(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with credential-like names are masked whole; the texts of the others are searched for secrets."""
    secret, bearer = r"(?i)\b(api_?key|token|secret|password)(\s*[=:]\s*)\S+", r"(?i)\b(bearer\s+)\S+"
    named = lambda c: any(w in c.lower() for w in ("api_key", "apikey", "token", "secret", "password"))
    masked = lambda c: F.regexp_replace(F.regexp_replace(F.col(c), secret, "$1$2[REDACTED]"), bearer, "$1[REDACTED]")
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), F.lit("[REDACTED]")) if named(c) else masked(c) for c in columns})
