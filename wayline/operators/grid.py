"""Slices of gridded fields held as rows (valid_time, level, lat, lon, name, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_time(grid: DataFrame, name: str, valid_time: int) -> DataFrame:
    """The field's rows at exactly ``valid_time``; stops the job where a place has not just one value a level."""
    rows = grid.where((F.col("name") == name) & (F.col("valid_time") == valid_time))
    one = rows.groupBy("level", "lat", "lon").agg(F.first("value").alias("value"), F.count("*").alias("n"))
    return one.withColumn("ok", F.assert_true(F.col("n") == 1, F.lit("more than one value of a field at a place and time"))).where("ok IS NULL").drop("n", "ok")


def nearest_level(rows: DataFrame, level: float, within: float = 0.01) -> DataFrame:
    """The rows of the level nearest to ``level``; none if it is not within ``within``."""
    levels = rows.select("level").distinct().withColumn("off", F.abs(F.col("level") - level))
    best = levels.agg(F.min_by("level", F.struct("off", "level")).alias("level"), F.min("off").alias("off")).where(F.col("off") <= within)
    return rows.join(F.broadcast(best.select("level")), "level", "left_semi")  # one row


def accumulation(grid: DataFrame, name: str, start: int, end: int, scale: float = 1000.0, least: float = 0.1) -> DataFrame:
    """(lat, lon, value): the scaled growth of an accumulated field from ``start`` to ``end``, null where under ``least``."""
    at = lambda t, c: exact_time(grid, name, t).select("lat", "lon", F.col("value").alias(c))
    grown = (F.col("b") - F.col("a")) * scale
    return at(start, "a").join(at(end, "b"), ["lat", "lon"]).select("lat", "lon", F.when(grown >= least, grown).alias("value"))


def thinned(rows: DataFrame, step: float, stride: int) -> DataFrame:
    """Every ``stride``-th row and column of a grid whose coordinates are multiples of ``step``."""
    on = lambda c: F.pmod(F.round(F.col(c) / step).cast("long"), F.lit(stride)) == 0
    return rows.where(on("lat") & on("lon"))


def colour_limit(rows: DataFrame, least: float, step: float) -> DataFrame:
    """One row: the largest value, NaN and null skipped, rounded up to ``step``, and ``least`` at least."""
    top = F.max(F.when(~F.isnan("value"), F.col("value")))
    return rows.agg(F.greatest(F.lit(least), F.ceil(top / step) * step).alias("upper"))
