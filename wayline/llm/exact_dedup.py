"""Exact dedup: groups of a 128-bit content hash, with the bytes compared inside each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, read


def content_hash(text: Column) -> Column:
    """128 bits (MD5) of the text in UTF-8."""
    return F.unhex(F.md5(text))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """All rows of ``docs`` with ``keep_id``, ``group_size`` and ``kept``.

    Rows with equal texts form a group, whose ``smallest`` or ``largest`` id stays. A null text
    counts as empty. Null ids never stay while the group has another id; a group of null ids only
    has a null ``keep_id`` and keeps its rows. Repeated rows count in ``group_size`` and share
    ``kept``, because an id stands for one document. An empty table gives no rows. Columns of the
    added names are replaced.

    Only hashes are shuffled to find the groups. Then the rows whose hash repeats are grouped by
    hash and text, which compares the bytes; copies collapse before the shuffle, so a huge group
    moves one row per task. Two texts under one hash become two groups.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    names = [c for c in docs.columns if c.lower() not in ("keep_id", "group_size", "kept")]
    base = docs.select(*names, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    base = base.withColumn("__hash", hash_of(F.col("__text")))
    repeated = materialise(base.groupBy("__hash").count().where("count > 1").select("__hash"))
    n_repeated = repeated.count()
    by_text = (
        base.select("__hash", "__text", id_col)
        .join(broadcast_if_small(repeated, n_repeated), "__hash", "left_semi")
        .groupBy("__hash", "__text")
        .agg(best(id_col).alias("__keep"), F.count("*").alias("__size"))
    )
    texts = F.count("*").over(Window.partitionBy("__hash"))
    groups = materialise(by_text.withColumn("__texts", texts).select("__hash", F.when(F.col("__texts") > 1, F.col("__text")).alias("__other"), "__keep", "__size"))
    collided = bool(groups.where("__other IS NOT NULL").take(1))
    plain = broadcast_if_small(groups.where(F.col("__other").isNull()).drop("__other"), n_repeated).withColumnRenamed("__hash", "__group")
    if not collided:
        out = base.join(plain, F.col("__hash") == F.col("__group"), "left")
    else:
        # only rows of a hash that several texts share need their texts in the join
        shared = broadcast_if_small(groups.where("__other IS NOT NULL").select(F.col("__hash").alias("__group")).distinct(), n_repeated)
        alone = base.join(shared, F.col("__hash") == F.col("__group"), "left_anti").join(plain, F.col("__hash") == F.col("__group"), "left")
        texts = groups.where("__other IS NOT NULL").withColumnRenamed("__hash", "__group")
        together = base.join(shared, F.col("__hash") == F.col("__group"), "left_semi").join(texts, (F.col("__hash") == F.col("__group")) & (F.col("__text") == F.col("__other")))
        out = alone.unionByName(together.drop("__other"))
    own = F.col("__size").isNull()
    keep_id = F.when(own, F.col(id_col)).otherwise(F.col("__keep"))
    return out.select(*names, keep_id.alias("keep_id"), F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"), F.col(id_col).eqNullSafe(keep_id).alias("kept"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the digest is made before the join, which then carries no text
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
    return exact_dedup(docs, keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256
FROM d
"""
