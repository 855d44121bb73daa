"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators.common import ensure_checkpoint_dir, materialise  # noqa: F401  materialise is for the operators

#: Where the tables of :func:`stored` lie, by the id of the frame.
_folders: dict[int, str] = {}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A side of a join is broadcast only when a count has shown that it has at most
#: this many rows of a few dozen bytes; beyond that the join shuffles.
BROADCAST_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other character alone."""
    return F.translate(text, UPPER, LOWER)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when ``rows``, its counted size, is within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores added until no column of ``columns`` has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back.

    Unlike a checkpoint it is compressed and forgets how it was partitioned, so that a join of it
    shuffles both sides and adaptive execution can split a hot key.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[id(out)] = path
    weakref.finalize(out, _folders.pop, id(out), None)
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables made by :func:`stored` on which no later result rests; other frames are left alone."""
    for table in tables:
        if path := _folders.pop(id(table), None):
            jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
