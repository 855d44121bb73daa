"""Sinks: CSV, JSON and text files, and the wide form of a distance matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, order: list[str], compress: bool = False, files: int | None = None) -> None:
    """CSV with a header in the order of ``order``: range-partitioned files, so that sorting needs no single task."""
    sorted_df = df.orderBy(*order)
    writer = (sorted_df.coalesce(files) if files else sorted_df).write.mode("overwrite").option("header", True)
    (writer.option("compression", "gzip") if compress else writer).csv(path)


def write_json_report(df: DataFrame, path: str) -> None:
    """One JSON object per row; meant for reports of one row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def wide_matrix(pairs: DataFrame, ids: list, i: str = "i", j: str = "j", d: str = "d") -> DataFrame:
    """One row and one column per id, 0 on the diagonal, from the long upper triangle (i, j, d); for id lists of known, small length."""
    both = pairs.select(i, j, d).unionByName(pairs.select(F.col(j).alias(i), F.col(i).alias(j), d))
    return both.groupBy(i).pivot(j, ids).agg(F.max(d)).na.fill(0.0)


def long_matrix(wide: DataFrame, ids: list, i: str = "i") -> DataFrame:
    """The long upper triangle (a, b, hausdorff_km) of a wide matrix whose rows and columns are ``ids``, in their order.

    An error unless every id has one row and one column, and the matrix is finite, not negative,
    symmetric and 0 on its diagonal, to 1e-8.
    """
    names = [c for c in wide.columns if c != i]
    if len(set(ids)) != len(ids) or sorted(names) != sorted(map(str, ids)):
        raise ValueError("the columns are not the ids")
    at = F.create_map(*[F.lit(v) for k, c in enumerate(ids) for v in (str(c), k)])
    cells = wide.unpivot([i], names, "j", "d").select(at[F.col(i).cast("string")].alias("p"), at[F.col("j")].alias("q"), F.col("d").cast("double").alias("d"))
    pairs = cells.groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.count("p").alias("n"), F.min("d").alias("low"), F.max("d").alias("d"), F.count("d").alias("known"))
    same = F.col("p") == F.col("q")
    sound = F.col("p").isNotNull() & (F.col("n") == F.when(same, 1).otherwise(2)) & (F.col("known") == F.col("n")) & (F.col("low") >= 0) & (F.col("d") < float("inf")) & (F.col("d") - F.col("low") <= 1e-8) & (~same | (F.col("d") <= 1e-8))
    seen = pairs.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(sound, F.lit(False))).alias("bad")).first()
    if seen["bad"] or seen["n"] != len(ids) * (len(ids) + 1) // 2:
        raise ValueError("the matrix does not fit the ids, or is not symmetric with a zero diagonal")
    id_of = F.array(*[F.lit(c) for c in ids])
    return pairs.where(~same).select(id_of[F.col("p")].alias("a"), id_of[F.col("q")].alias("b"), F.col("d").alias("hausdorff_km"))
