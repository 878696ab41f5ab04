"""Lineage cuts in the shared folder, size-checked broadcasts, and joins with groups that may be very large."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.words import tidy

Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Rows of an Arrow batch: ten thousand, Spark's own number, are some 100 MB of texts or shingles on both sides of each worker.
BATCH_ROWS = 1_000
#: Bytes that a broadcast table may have (as rows in memory, beside their hash table); beyond it the join is left to a shuffle.
BROADCAST_BYTES = 64 << 20
#: A key is hot if it has more rows than this share of the table, and never below HOT_ROWS; so at most HOT_KEYS keys are hot.
HOT_KEYS, HOT_ROWS = 512, 2_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session whose executors are this machine may do without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: later stages don't depend on executors' disks."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mapped(rows: DataFrame, step: Step, schema: str | T.StructType) -> DataFrame:
    """rows through a Python step in Arrow batches of at most ``BATCH_ROWS`` rows, whole texts each: what a task holds on either
    side of the pipe is bounded by that. Spark takes the number of rows from the session, where a smaller one is left as it is."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = rows.sparkSession.conf
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return rows.mapInArrow(tidy(step), schema)


def fits(table: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a table, one that ``cut`` has written or that is as cheap to read, is small enough to send to every executor."""
    wide = [F.octet_length(f.name) if isinstance(f.dataType, T.StringType) else 8 * F.size(f.name) for f in table.schema if isinstance(f.dataType, T.StringType | T.ArrayType)]
    rows, more = table.select(F.count(F.lit(1)), F.coalesce(F.sum(sum(map(lambda c: F.coalesce(c, F.lit(0)), wide), F.lit(0))), F.lit(0))).first()
    return rows * (16 + 8 * len(table.columns)) + more <= limit


def small(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a table for broadcast if its measured size allows it."""
    return F.broadcast(table) if fits(table, limit) else table


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, size: str = "m") -> DataFrame:
    """rows (``total`` of them) joined with groups, written by ``cut``: one row a key, and in ``size`` how many rows the key
    has. The rows of hot keys, few keys by the bound above, meet their groups by broadcast, so that no task gets a whole hot
    group; the rest is shuffled."""
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = groups.where(F.col(size) > limit)
    if not hot.limit(1).count():
        return rows.join(groups.drop(size), keys)
    hot = F.broadcast(hot.drop(size))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(groups.where(F.col(size) <= limit).drop(size), keys)
    return rows.join(hot, keys).unionByName(cold)
