"""Where checkpoints and cut lineages go."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session whose executors are this machine may do without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
