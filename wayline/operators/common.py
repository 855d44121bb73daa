"""Lineage cuts that survive lost executors, and ranks over all rows without a single task."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local master without one gets a local folder, a cluster an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return shared or spark.sparkContext.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder in ``spark.checkpoint.dir`` and cuts its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    Unlike a checkpoint it forgets what Spark's optimizer had concluded about its rows, which in a long loop of joins grows
    with every round and slows planning down.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``df`` with ``name``, the place of each row in the order, from 0.

    The rows are sorted by ranges and stay so in the shared folder; a row's place is its place within
    its partition and the number of rows in the partitions before, one number each on the driver.
    """
    at = F.monotonically_increasing_id()
    rows = materialise(df.orderBy(*order)).withColumn("__at", at)
    part = F.shiftright("__at", 33).cast("int")
    sizes = {r["p"]: r["count"] for r in rows.groupBy(part.alias("p")).count().collect()}
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    offset = F.element_at(F.array(*map(F.lit, before or [0])), part + 1)
    return rows.withColumn(name, (offset + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("__at")
