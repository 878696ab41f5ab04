"""Option chains: pairs at the money, spreads, expiry buckets, quote rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.windows import six


def chain(part: DataFrame) -> DataFrame:
    """A chain from parts: brand as root, size as strike, parity as side, the least price as quote."""
    return part.groupBy(F.col("p_brand").alias("root"), F.col("p_size").alias("strike"), F.when(F.col("p_partkey") % 2 == 0, "call").otherwise("put").alias("side")).agg(F.min("p_retailprice").alias("price"))


def at_the_money(chain: DataFrame, spot: float) -> DataFrame:
    """The strike nearest to spot (ties: the lower) that has both sides, and the pair's price."""
    pair = chain.groupBy("root", "strike").agg(F.max(F.when(F.col("side") == "call", F.col("price"))).alias("c"), F.max(F.when(F.col("side") == "put", F.col("price"))).alias("p")).where("c is not null and p is not null")
    near = F.struct(F.abs(F.col("strike") - spot), F.col("strike"))
    return pair.groupBy("root").agg(F.min_by("strike", near).alias("strike"), F.min_by(six(F.col("c") + F.col("p")), near).alias("straddle"))


def vertical_spreads(chain: DataFrame, settle: float) -> DataFrame:
    """Neighbouring call strikes: debit and profit at a settlement price."""
    w = Window.partitionBy("root").orderBy("strike")
    c = chain.where("side = 'call'").select("root", "strike", "price", F.lead("price").over(w).alias("nxt"), F.lead("strike").over(w).alias("ns")).where("nxt is not null")
    debit = F.col("price") - F.col("nxt")
    payoff = F.least(F.greatest(settle - F.col("strike"), F.lit(0)), F.col("ns") - F.col("strike"))
    return c.select("root", "strike", six(debit).alias("debit"), six(payoff - debit).alias("pnl"))


def quote_reason(bid: Column, ask: Column, most_spread: float = 0.5) -> Column:
    """The first rule that a quote fails."""
    mid = (bid + ask) / 2
    return F.when(bid.isNull() | ask.isNull(), "missing").when((bid <= 0) | (ask <= 0), "non_positive").when(bid > ask, "crossed").when((ask - bid) / mid > most_spread, "wide")
