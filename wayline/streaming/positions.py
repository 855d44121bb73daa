"""The cleaning rules on streams of positions: per-row reasons, late rows and repeats, sessions between gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators.clean import MAX_AGE_SEC, reject_rows


def valid_positions(points: DataFrame, flights: DataFrame, delay: str = "2 minutes", max_age: float = MAX_AGE_SEC) -> DataFrame:
    """Valid rows of a stream, the first of each (flight, position update) within the watermark.

    ``points`` has an event time ``ts``; ``flights`` is a static table. Rows later than ``delay`` are
    dropped, and the state of an update is forgotten after it.
    """
    kept = reject_rows(points, flights, max_age).where("removal_reason = ''")
    return kept.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["flight_id", "lastposupdate"])


def sessions(points: DataFrame, delay: str = "2 minutes", gap: str = "60 seconds") -> DataFrame:
    """(flight_id, first, last, points) of runs of positions without a longer gap, once the watermark has passed them."""
    window = F.session_window("ts", gap)
    return points.withWatermark("ts", delay).groupBy("flight_id", window.alias("w")).agg(F.count("*").alias("points"), F.max("ts").alias("last")).select("flight_id", F.col("w.start").alias("first"), "last", "points")
