"""Sharding by a hypergeometric communication matrix (law `rows`): a uniform random shuffle with exact shard sizes.

Rows are dealt into blocks by a hash. With the exact block sizes, the matrix of how many rows of each block go to each
shard is drawn from the multivariate hypergeometric law that a uniform shuffle has: block after block, shard after shard,
without replacement. Each block then permutes its rows (order by a keyed hash) and cuts that order by its row of the
matrix, rows are exchanged, and each shard permutes again, which gives the slots. Only DataFrame functions touch rows; the
driver sees one count for each block (``MAX_BLOCKS`` at most).

Defined results: shard sizes differ by one at most; a null text has size 16 and the checksum 0 of no bytes; repeated rows
get places of their own; rows without a doc_id, or with the same one, are dealt by their texts; rows equal in the hashes are
ordered by doc_id, checksum and size; a very long text is a row like any other; doc_id must be a whole number; an empty table gives no rows; other columns are not read. Slots are
gapless in each shard: they are ranks in ranges of the second hash, plus the counts of the ranges before.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS, OVERHEAD, BLOCK_ROWS, MAX_BLOCKS, RANGE_ROWS = 40, 16, 2_000, 65_536, 4_000


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def communication_matrix(blocks: Sequence[int], shards: int, seed: int = 1) -> np.ndarray:
    """counts[b, s]: row sums are the block sizes, column sums the shard sizes. Each row is drawn given those before."""
    rng = np.random.default_rng(seed)
    left = np.array(shard_sizes(sum(blocks), shards), np.int64)
    out = np.zeros((len(blocks), shards), np.int64)
    for b, n in enumerate(blocks):
        need, rest = int(n), int(left.sum())
        for s in range(shards):
            rest -= int(left[s])
            own = _draw(rng, int(left[s]), rest, need)
            out[b, s] = own
            need -= own
        left -= out[b]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw, also beyond the generator's range (10^9): each row is taken with chance n / total, which is two
    binomial draws; given how many were taken they are any of that many, so the few missing are drawn from the rest, or the
    few too many from those taken, by the same law."""
    if n <= 0 or good <= 0:
        return 0
    if bad <= 0:
        return n
    total = good + bad
    if total < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    if n < 100:
        own = 0
        for i in range(n):
            own += int(rng.integers(total - i) < good - own)
        return own
    x, y = int(rng.binomial(good, n / total)), int(rng.binomial(bad, n / total))
    more = n - x - y
    return x + _draw(rng, good - x, bad - y, more) if more >= 0 else x - _draw(rng, x, y, -more)


def sharded(documents: DataFrame, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of documents."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    total = documents.select("doc_id").count()
    blocks = max(1, min(MAX_BLOCKS, round(total / BLOCK_ROWS)))
    block = F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(seed)), F.lit(blocks)).cast("int")
    sizes = [0] * blocks
    for r in rows.groupBy(block.alias("b")).count().collect():
        sizes[r["b"]] = r["count"]
    cuts = np.cumsum(communication_matrix(sizes, shards, seed), axis=1)
    local = Window.partitionBy("block").orderBy("h1", "doc_id", "text_crc32", "size")
    placed = rows.withColumns({"block": block, "h1": F.xxhash64("doc_id", "text_crc32", F.lit(f"first{seed}"))}).withColumn("rank", F.row_number().over(local))
    matrix = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(cuts.tolist())), "array<array<bigint>>")).alias("block", "cuts"))
    shard: Column = F.size(F.filter("cuts", lambda c: c < F.col("rank")))
    ranges = max(1, round(total / shards / RANGE_ROWS))
    h2 = F.xxhash64("doc_id", "text_crc32", F.lit(f"second{seed}"))
    dealt = placed.join(F.broadcast(matrix), "block").select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), h2.alias("h2"))
    dealt = dealt.withColumn("range", (F.shiftrightunsigned("h2", 33) % ranges).cast("int"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("shard", "range").count().select("shard", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "range").orderBy("h2", "doc_id", "text_crc32", "size")
    ranked = dealt.withColumn("r", F.row_number().over(inside))
    return ranked.join(base, ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("r") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
