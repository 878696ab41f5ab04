"""Redaction, search, and frozen scaling with a score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def redact(rows: DataFrame, column: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """Key-value secrets and long hexadecimal runs are masked."""
    t = F.regexp_replace(column, r'(?:password|token|secret)\s*[=:]\s*"?[A-Za-z0-9]+"?', mark)
    return rows.withColumn(column, F.regexp_replace(t, r"\b[0-9a-f]{16,}\b", mark))


def search(rows: DataFrame, literal: str, column: str = "text") -> DataFrame:
    hits = ((F.length(column) - F.length(F.replace(F.col(column), F.lit(literal), F.lit("")))) / len(literal)).cast("bigint")
    return rows.where(F.contains(F.col(column), F.lit(literal))).select("doc_id", hits.alias("hits"))


def scaled_score(rows: DataFrame, clip: float = 5.0) -> DataFrame:
    """Median and interquartile scaling of each dimension (fitted once, a few rows), clipped, weighted by 1/i, through a sigmoid."""
    flat = rows.select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", (F.col("i") + 1).alias("i"), F.col("v").cast("double").alias("v"))
    fitted = flat.groupBy("i").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    width = F.col("q")[2] - F.col("q")[0]
    z = F.when(width > 0, (F.col("v") - F.col("q")[1]) / width).otherwise(0.0)
    x = F.greatest(F.least(z, F.lit(clip)), F.lit(-clip)) / F.col("i")
    return flat.join(F.broadcast(fitted), "i").groupBy("vec_id").agg(F.round(1 / (1 + F.exp(-F.sum(x))), 4).alias("score"))
