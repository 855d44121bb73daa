"""Cleaning of positions under rules that leave a reason, and the quality summary of every flight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.geo import haversine_km, inside

# Fixed values of the standard rules.
MAX_AGE_SEC, MAX_GAP_SEC, MIN_POINTS, AIRPORT_KM = 15.0, 60.0, 100, 15.0
SPEED_KM_S, TOLERANCE_KM = 0.450, 2.0
# Places (latitude, longitude) of the airports that the standard report is about.
DEPARTURE, ARRIVAL = (51.4706, -0.4619), (50.038, 8.5622)
ORDER = ("lastposupdate", "state_time", "event_id")


def reject_rows(points: DataFrame, flights: DataFrame, max_age: float = MAX_AGE_SEC) -> DataFrame:
    """All points with ``removal_reason``, the first rule that a row breaks, or an empty string.

    ``flights`` (flight_id, icao24, start_unix, end_unix) has one row a flight; Spark broadcasts it
    while it is small. A missing value breaks its rule.
    """
    dim = flights.select("flight_id", F.col("icao24").alias("__plane"), "start_unix", "end_unix")
    age, contact = F.col("state_time") - F.col("lastposupdate"), F.col("state_time") - F.col("lastcontact")
    rules = [  # fixed values: the names and order of the reasons
        ("invalid_coordinate", inside(F.col("lat"), -90, 90) & inside(F.col("lon"), -180, 180)),
        ("stale_or_invalid_position_time", inside(age, 0, max_age)),
        ("stale_or_invalid_contact_time", inside(contact, 0, max_age)),
        ("aircraft_mismatch", F.coalesce(F.col("icao24") == F.col("__plane"), F.lit(False))),
        ("outside_flight_interval", inside(F.col("state_time"), F.col("start_unix"), F.col("end_unix") + 1)),
    ]
    reason = F.coalesce(*[F.when(~kept, F.lit(name)) for name, kept in rules], F.lit(""))
    return points.join(dim, "flight_id", "left").withColumn("removal_reason", reason).drop("__plane", "start_unix", "end_unix")


def reject_repeats(points: DataFrame) -> DataFrame:
    """Marks all but the first valid row of each (flight, position update); rejected rows neither count nor change."""
    valid = F.col("removal_reason") == ""
    nth = F.row_number().over(Window.partitionBy("flight_id", "lastposupdate", valid).orderBy("state_time", "event_id"))
    return points.withColumn("removal_reason", F.when(valid & (nth > 1), "duplicate_position_update").otherwise(F.col("removal_reason")))


def legs(points: DataFrame) -> DataFrame:
    """The points with the gap (s), distance (km) and bad flag of the leg that ends in each; null for a flight's first."""
    w = Window.partitionBy("flight_id").orderBy(*ORDER)
    before = lambda c: F.lag(c).over(w)
    out = points.withColumns({"gap_sec": F.col("lastposupdate") - before("lastposupdate"), "step_km": haversine_km(before("lat"), before("lon"), F.col("lat"), F.col("lon"))})
    return out.withColumn("bad_leg", F.col("step_km") > SPEED_KM_S * F.col("gap_sec") + TOLERANCE_KM)


def flight_qc(
    marked: DataFrame,
    flights: DataFrame,
    min_points: int = MIN_POINTS,
    max_gap: float = MAX_GAP_SEC,
    airport_km: float = AIRPORT_KM,
    departure: tuple[float, float] = DEPARTURE,
    arrival: tuple[float, float] = ARRIVAL,
) -> DataFrame:
    """One row per flight: counts, gaps, duration, distances of its ends from ``departure`` and ``arrival``, open jumps, status and reasons.

    ``marked`` has a ``removal_reason`` on every row. A flight of one clean point has an infinite
    largest gap and no median gap; one without any has ``no_valid_points`` and nulls.
    """
    counted = marked.groupBy("flight_id").agg(F.count("*").alias("raw_points"))
    first, last = F.struct(*ORDER), F.struct(*ORDER)
    end = lambda c, pick, key: pick(c, key)
    clean = legs(marked.where("removal_reason = ''")).groupBy("flight_id").agg(
        F.count("*").alias("clean_points"),
        F.coalesce(F.max("gap_sec"), F.lit(float("inf"))).alias("max_gap_sec"),
        F.median("gap_sec").alias("median_gap_sec"),
        ((F.max("lastposupdate") - F.min("lastposupdate")) / 60).alias("observed_duration_min"),
        haversine_km(end("lat", F.min_by, first), end("lon", F.min_by, first), F.lit(departure[0]), F.lit(departure[1])).alias("start_distance_km"),
        haversine_km(end("lat", F.max_by, last), end("lon", F.max_by, last), F.lit(arrival[0]), F.lit(arrival[1])).alias("end_distance_km"),
        F.count_if("bad_leg").alias("unresolved_jump_segments"),
    )
    out = flights.select("flight_id").join(counted, "flight_id", "left").join(clean, "flight_id", "left")
    none = F.col("clean_points").isNull()
    reasons = F.concat_ws(";",  # fixed values: the names and order of the reasons
        F.when(F.col("clean_points") < min_points, "too_few_points"),
        F.when(F.col("max_gap_sec") > max_gap, "gap_over_limit"),
        F.when((F.col("start_distance_km") > airport_km) | (F.col("end_distance_km") > airport_km), "endpoint_outside_15km"),
        F.when(F.col("unresolved_jump_segments") > 0, "unresolved_position_jump"),
        F.when(none, "no_valid_points"),
    )
    raw, kept = F.coalesce("raw_points", F.lit(0)), F.coalesce("clean_points", F.lit(0))
    return out.select("flight_id", raw.alias("raw_points"), kept.alias("clean_points"), (raw - kept).alias("removed_points"), "max_gap_sec", "median_gap_sec", "observed_duration_min", "start_distance_km", "end_distance_km", "unresolved_jump_segments", reasons.alias("review_reason")).withColumn("status", F.when(F.col("review_reason") == "", "pass").otherwise("review"))


def preparation_report(marked: DataFrame, qc: DataFrame, expected_callsign: Column) -> DataFrame:
    """One row: point and flight counts, reasons as maps, and the callsign diagnosis."""
    freq = lambda df, c: df.groupBy(c).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "count")))).alias("m"))
    call = F.upper(F.trim(F.coalesce("callsign", F.lit(""))))
    rows = marked.agg(F.count("*").alias("raw_points"), F.count_if(F.col("removal_reason") == "").alias("clean_points"), F.count_if(F.col("removal_reason") != "").alias("removed_points"), F.count_if(call == "").alias("missing_callsign_rows"), F.count_if((call != "") & (call != expected_callsign)).alias("unexpected_callsign_rows"))
    passed = F.col("status") == "pass"
    of = qc.agg(F.count("*").alias("input_flights"), F.count_if(passed).alias("accepted_flights"), F.count_if(~passed).alias("review_flights"), F.coalesce(F.sum(F.when(passed, F.col("clean_points"))), F.lit(0)).alias("accepted_points"), F.max(F.when(passed, F.col("max_gap_sec"))).alias("accepted_worst_gap_sec"))
    reasons = freq(marked.where("removal_reason <> ''"), "removal_reason").withColumnRenamed("m", "removal_reasons")
    reviews = freq(qc.where(~passed), "review_reason").withColumnRenamed("m", "review_reasons")
    return rows.crossJoin(of).crossJoin(reasons).crossJoin(reviews)  # four sides of one row each


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """``df``, stopping the job where a key repeats."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("__ok", F.assert_true(n == 1, F.lit(f"{key} repeats"))).where("__ok IS NULL").drop("__ok")


def exactly_one(df: DataFrame, what: str = "row") -> DataFrame:
    """``df``, or an error unless it has just one row."""
    n = len(df.take(2))
    if n != 1:
        raise ValueError(f"{'no' if n == 0 else 'more than one'} {what}")
    return df


def require_same_keys(a: DataFrame, b: DataFrame, key: str) -> None:
    """An error if a side has a key that the other has not, or has one twice."""
    for df, side in ((a, "left"), (b, "right")):
        if df.groupBy(key).count().where("count > 1").take(1):
            raise ValueError(f"{key} repeats on the {side}")
    if found := key_differences(a, b, key).take(1):
        raise ValueError(f"{key} {found[0][0]} is only on the {found[0][1]}")


def validated_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every row of ``left`` with its row of ``right``; the job stops where a key repeats on either side or has no row."""
    there = assert_unique(right, key).withColumn("__there", F.lit(True))
    out = assert_unique(left, key).join(there, key, "left")
    return out.withColumn("__ok", F.assert_true(F.coalesce("__there", F.lit(False)), F.lit(f"{key} without a row on the right"))).where("__ok IS NULL").drop("__ok", "__there")


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has."""
    only = lambda x, y, name: x.select(key).distinct().join(y.select(key).distinct(), key, "left_anti").withColumn("side", F.lit(name))
    return only(a, b, "left").unionByName(only(b, a, "right"))
