"""A training corpus from raw documents: quality, exact copies, near copies, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, which has the columns of
``documents``; columns beyond those are passed on by all stages but the last. Rows with a null id are
not learnt from and are judged like any others: the first two stages keep or drop them by their text,
the third keeps them, because an unknown document is linked with nothing. Null and empty texts count
as the same text. Repeated rows of one id are one document and stay or go together. Empty tables pass
through every stage.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wayline.llm.common import drop, read, stored, unused  # noqa: E402
from wayline.llm.exact_dedup import exact_dedup  # noqa: E402
from wayline.llm.ngram_join import jaccard_classes  # noqa: E402
from wayline.llm.packing import pack_documents  # noqa: E402
from wayline.llm.quality import fit_quality, learning_labels, score_quality  # noqa: E402
from wayline.shipping import ship  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; it learns from the labels outside the held-out fold."""
    ship(spark)
    model = fit_quality(docs, learning_labels(spark, sf_dir))
    renamed = {c: unused(f"__{c}", docs.columns) for c in docs.columns if c.lower() in ("score", "predicted")}
    kept = score_quality(docs.withColumnsRenamed(renamed), model).where("predicted = 1").drop("score", "predicted")
    return kept.withColumnsRenamed({v: k for k, v in renamed.items()}).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each text."""
    renamed = {c: unused(f"__{c}", docs.columns) for c in docs.columns if c.lower() in ("keep_id", "group_size", "kept")}
    out = exact_dedup(docs.withColumnsRenamed(renamed), keep="smallest").where("kept").drop("keep_id", "group_size", "kept")
    return out.withColumnsRenamed({v: k for k, v in renamed.items()}).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies, linked by word shingles."""
    ship(spark)
    gone = stored(jaccard_classes(docs).where("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents to length buckets and batches by their byte-pair tokens: doc_id, n_tokens, bucket, bucket_length, batch, slot, padding."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("packing", packed)]

#: SQL can't express the classifier's training.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each reads what the one before it wrote."""
    ship(spark)
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before = docs
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
            drop(before)  # the table that the stage has read; ``documents`` itself is left alone
    return docs
