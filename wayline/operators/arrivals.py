"""Positions of selected arrivals by interval join, their checks, and segments between gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.geo import inside
from wayline.operators.common import materialise
from wayline.sources.tables import text_key, utc_text

BEFORE_SEC, AFTER_SEC, MIN_MATCHES, MIN_ROWS, GAP_SEC = 600.0, 240.0, 3, 5, 60.0


def valid_arrivals(arrivals: DataFrame, plane_pattern: str = "^[0-9a-f]{6}$") -> DataFrame:
    """(callsign, icao24, firstseen, lastseen) with clean keys, one row a (callsign, icao24, lastseen): the earliest seen first."""
    plane = F.lower(F.trim(F.coalesce("icao24", F.lit(""))))
    named = arrivals.select(text_key(F.col("callsign")).alias("callsign"), plane.alias("icao24"), "firstseen", "lastseen").dropna()
    return named.where(F.col("icao24").rlike(plane_pattern) & (F.col("callsign") != "")).groupBy("callsign", "icao24", "lastseen").agg(F.min("firstseen").alias("firstseen"))


def interval_join(points: DataFrame, intervals: DataFrame, key: str, t: str = "t", low: str = "low", high: str = "high") -> DataFrame:
    """Rows of both sides with equal ``key`` and ``low`` <= ``t`` <= ``high``, both ends included.

    They meet on the key and a bin of time, so a key with many points and many intervals is spread over its bins and the
    pairs looked at grow with those found. A bin is as long as the intervals are on average: then all of them lie in at
    most three bins each on average, whatever the longest is. Null keys, times and ends join nothing, nor do intervals
    that end before they begin. The sides share no column but the key.
    """
    kept = intervals.where(F.col(low) <= F.col(high))
    width = kept.agg(F.avg(F.col(high) - F.col(low))).first()[0] or 1.0
    bin_of = lambda c: F.floor(F.col(c) / F.lit(float(width))).cast("long")
    cells = kept.withColumn("__bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    return points.withColumn("__bin", bin_of(t)).join(cells, [key, "__bin"]).where(F.col(t).between(F.col(low), F.col(high))).drop("__bin")


def arrival_points(arrivals: DataFrame, points: DataFrame, first: float, last: float) -> DataFrame:
    """Points (icao24, t, ...) of each arrival's aircraft from 10 minutes before it is first to 4 after it is last seen.

    Both ends count, and ``first`` and ``last`` bound all of them. Where at least three points carry
    the arrival's callsign, points of another, non-blank callsign are left out. A repeated (t, lat,
    lon) counts once, the row with the smallest update time.
    """
    a = arrivals.select("callsign", F.col("icao24").alias("plane"), "lastseen", F.greatest(F.lit(first), F.col("firstseen") - BEFORE_SEC).alias("low"), F.least(F.lit(last), F.col("lastseen") + AFTER_SEC).alias("high"))
    p = points.withColumns({"icao24": F.lower(F.trim(F.coalesce("icao24", F.lit("")))), "point_callsign": text_key(F.col("callsign"))}).drop("callsign").dropna(subset=["t", "lat", "lon"])
    joined = interval_join(p, a.withColumnRenamed("plane", "icao24"), "icao24").drop("low", "high")
    flight = ["callsign", "icao24", "lastseen"]
    match = F.col("point_callsign") == F.col("callsign")
    own = match | (F.col("point_callsign") == "")
    update = F.col("lastposupdate")
    places = materialise(joined.groupBy(*flight, "t", "lat", "lon").agg(F.count_if(match).alias("matches"), F.count_if(own).alias("own"), F.min(update).alias("any_update"), F.min(F.when(own, update)).alias("own_update")))
    named = places.groupBy(*flight).agg((F.sum("matches") >= MIN_MATCHES).alias("named"))
    kept = places.join(named, flight).where(~F.col("named") | (F.col("own") > 0))
    return kept.select(*flight, "t", "lat", "lon", F.when(F.col("named"), F.col("own_update")).otherwise(F.col("any_update")).alias("lastposupdate"))


def arrival_checks(arrivals: DataFrame, matched: DataFrame, max_age: float = 15.0) -> DataFrame:
    """One row per arrival: matched points, those with a position age in [0, 15] s, and a status."""
    valid = inside(F.col("t") - F.col("lastposupdate"), 0, max_age)
    flight = ["callsign", "icao24", "lastseen"]
    n = matched.groupBy(*flight).agg(F.count("*").alias("n"), F.count_if(valid).alias("ok"))
    rows, ok = F.coalesce("n", F.lit(0)), F.coalesce("ok", F.lit(0))
    # fixed values: the names of the three states
    status = F.when(rows < MIN_ROWS, "INSUFFICIENT_POSITION_ROWS").when(ok < F.greatest(F.lit(5), F.floor(rows * 8 / 10)), "NEEDS_POSITION_AGE_QA").otherwise("AGE_RANGE_PLAUSIBLE_CHECK_OTHER_QA")
    return arrivals.select(*flight).join(n, flight, "left").select(*flight, rows.alias("matched_points"), ok.alias("ages_between_0_and_15s"), status.alias("status"))


def route_manifest(points: DataFrame, t: str = "t", least: int = MIN_ROWS) -> DataFrame:
    """One row per (callsign, source_file) with at least ``least`` points: their number, first and last time, and that no age was checked."""
    iso = lambda c: F.replace(utc_text(c), F.lit(" "), F.lit("T"))
    n = points.groupBy("callsign", "source_file").agg(F.count("*").alias("plotted_points"), iso(F.min(t)).alias("observed_first_utc"), iso(F.max(t)).alias("observed_last_utc"))
    return n.where(F.col("plotted_points") >= least).withColumn("position_age_verified", F.lit(False))


def gap_segments(points: DataFrame, gap: float = GAP_SEC, t: str = "t") -> DataFrame:
    """Adds ``segment_id`` from 0 per flight: a gap of more than ``gap`` seconds starts a new segment."""
    w = Window.partitionBy("flight_id").orderBy(t)
    new: Column = F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("int"), F.lit(0))
    return points.withColumn("__new", new).withColumn("segment_id", F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("__new")


def segments(points: DataFrame, gap: float = GAP_SEC, t: str = "t", least: int = 2) -> DataFrame:
    """(flight_id, segment_id, points, first_t, last_t) of the segments with at least ``least`` points."""
    return gap_segments(points, gap, t).groupBy("flight_id", "segment_id").agg(F.count("*").alias("points"), F.min(t).alias("first_t"), F.max(t).alias("last_t")).where(F.col("points") >= least)
