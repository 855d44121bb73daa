"""Down-sampling of trajectories to the observations nearest to regular times, and what it costs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.geo import EARTH_KM, haversine_km, ratio
from wayline.operators.common import materialise
from wayline.operators.hausdorff import SET_POINTS, dense_hausdorff, directed
from wayline.operators.quantiles import exact_quantiles


def nearest_observations(points: DataFrame, interval: int) -> DataFrame:
    """(flight_id, target, t, offset_sec): for every target start + k * ``interval`` up to the end, the nearest observed t.

    The earlier observation wins a tie. This is an as-of join from both sides, without a join: each
    observation makes the targets between the middle to the one before it and the middle to the one
    after it. ``points`` has one row per (flight_id, t).
    """
    w = Window.partitionBy("flight_id").orderBy("t")
    start, end = F.min("t").over(Window.partitionBy("flight_id")), F.max("t").over(Window.partitionBy("flight_id"))
    p = points.select("flight_id", "t", (F.col("t") - start).alias("at"), (end - start).alias("length"), (F.lag("t").over(w) - start).alias("before"), (F.lead("t").over(w) - start).alias("after"))
    step = F.lit(float(interval))
    # a target belongs here if before's middle < target <= after's middle, so ties go to the earlier one
    low = F.when(F.col("before").isNull(), F.lit(0)).otherwise(F.floor((F.col("before") + F.col("at")) / 2 / step) + 1)
    last = F.floor((F.col("length") + 1e-9) / step)
    high = F.when(F.col("after").isNull(), last).otherwise(F.least(last, F.floor((F.col("at") + F.col("after")) / 2 / step)))
    own = p.withColumns({"low": low.cast("long"), "high": high.cast("long")}).where("low <= high")
    k = own.select("flight_id", "t", "at", F.explode(F.sequence("low", "high")).alias("k"))
    target = F.col("k") * step
    return k.select("flight_id", "k", (target - F.col("at") + F.col("t")).alias("target"), "t", F.abs(target - F.col("at")).alias("offset_sec"))


def downsample(points: DataFrame, interval: int) -> DataFrame:
    """The rows of ``points`` whose t is chosen by some target, and each flight's first and last."""
    chosen = nearest_observations(points, interval).select("flight_id", "t")
    ends = points.groupBy("flight_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).select("flight_id", F.explode(F.array("a", "b")).alias("t"))
    return points.join(chosen.unionByName(ends).distinct(), ["flight_id", "t"], "left_semi")


def path_lengths(points: DataFrame) -> DataFrame:
    """(flight_id, points, path_km): the sum of the legs in the order of t; 0 for fewer than two points."""
    w = Window.partitionBy("flight_id").orderBy("t")
    step = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return points.withColumn("step", step).groupBy("flight_id").agg(F.count("*").alias("points"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("path_km"))


METRICS = "full_points long, full_path_km double, sampled_points long, sampled_path_km double, median_target_time_offset_sec double, p95_target_time_offset_sec double, max_target_time_offset_sec double, hausdorff_km double"


def _arc_km(lat: np.ndarray, lon: np.ndarray) -> float:
    """The length of a path, with the haversine clipped as in :func:`haversine_km`."""
    p, q = np.radians(lat), np.radians(lon)
    h = np.sin(np.diff(p) / 2) ** 2 + np.cos(p[:-1]) * np.cos(p[1:]) * np.sin(np.diff(q) / 2) ** 2
    return float((2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1)))).sum())


def _sampled(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, interval: int) -> tuple:
    """The values of ``METRICS`` of one flight in the order of time."""
    at = t - t[0]
    targets = np.arange(int(np.floor((at[-1] + 1e-9) / interval)) + 1) * float(interval)
    # a target up to the middle between two observations belongs to the earlier
    chosen = np.searchsorted((at[:-1] + at[1:]) / 2, targets, side="left")
    off = np.abs(targets - at[chosen])
    kept = np.isin(t, np.concatenate([t[chosen], t[:1], t[-1:]]))
    p, q = np.radians(lat), np.radians(lon)
    sphere = np.stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)], axis=1)
    # the sample is a part of the flight, so only the way from the flight to it counts
    apart = 2 * EARTH_KM * np.arcsin(min(1.0, np.sqrt(directed(sphere[~kept], sphere[kept])) / 2)) if not kept.all() else 0.0
    return (len(t), _arc_km(lat, lon), int(kept.sum()), _arc_km(lat[kept], lon[kept]), *np.percentile(off, [50, 95]).tolist(), float(off.max()), float(apart))


def _packed_metrics(points: DataFrame, intervals: list[int]) -> DataFrame:
    """One pass: each flight is one row, and many of them are measured at every interval in one batch."""
    packed = points.groupBy("flight_id").agg(F.sort_array(F.collect_list(F.struct("t", "lat", "lon"))).alias("p")).select("flight_id", "p.t", "p.lat", "p.lon")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["flight_id", "interval_sec", *(c.split()[0] for c in METRICS.split(", "))]
        for pdf in batches:
            flights = [(r.flight_id, *(np.asarray(v, float) for v in (r.t, r.lat, r.lon))) for r in pdf.itertuples()]
            yield pd.DataFrame([(i, s, *_sampled(t, lat, lon, s)) for i, t, lat, lon in flights for s in intervals], columns=names)

    return packed.mapInPandas(measure, f"flight_id {dict(points.dtypes)['flight_id']}, interval_sec int, {METRICS}")


def _spread_metrics(points: DataFrame, interval: int) -> DataFrame:
    """The same for flights of any length: their points are rows, and block by block in a task."""
    sample = materialise(downsample(points, interval))
    full = path_lengths(points).select("flight_id", F.col("points").alias("full_points"), F.col("path_km").alias("full_path_km"))
    part = path_lengths(sample).select("flight_id", F.col("points").alias("sampled_points"), F.col("path_km").alias("sampled_path_km"))
    off = materialise(nearest_observations(points, interval).select("flight_id", "offset_sec"))
    offsets = exact_quantiles(off, ["flight_id"], {"median_target_time_offset_sec": ("offset_sec", 0.5), "p95_target_time_offset_sec": ("offset_sec", 0.95)})
    most = off.groupBy("flight_id").agg(F.max("offset_sec").alias("max_target_time_offset_sec"))
    apart = dense_hausdorff(points, sample, ["flight_id"]).select("flight_id", "hausdorff_km")
    return full.join(part, "flight_id").join(offsets, "flight_id").join(most, "flight_id").join(apart, "flight_id").withColumn("interval_sec", F.lit(interval))


def downsampling_metrics(points: DataFrame, intervals: list[int], flight_points: int = SET_POINTS) -> DataFrame:
    """One row per (interval_sec, flight_id): retention, Hausdorff distance and path error of the sample, and target offsets.

    Flights of up to ``flight_points`` points are packed to a row each and measured at all intervals in one pass; longer ones
    stay spread over tasks. Rows with a null are left out, as are flights without rows.
    """
    points = materialise(points.select("flight_id", "t", "lat", "lon").dropna())
    sizes = materialise(points.groupBy("flight_id").agg(F.count("*").alias("n")).where(F.col("n") > flight_points).select("flight_id"))
    some = bool(sizes.take(1))
    out = _packed_metrics(points.join(sizes, "flight_id", "left_anti") if some else points, intervals)
    if some:
        long = materialise(points.join(sizes, "flight_id", "left_semi"))
        for interval in intervals:
            out = out.unionByName(_spread_metrics(long, interval))
    return out.withColumns({"retention_pct": 100.0 * F.col("sampled_points") / F.col("full_points"), "path_length_abs_error_pct": 100.0 * ratio(F.abs(F.col("sampled_path_km") - F.col("full_path_km")), F.col("full_path_km"))})


#: Rows up to which Spark's own percentile, which holds a group's distinct values in a task, is used.
PERCENTILE_ROWS = 1_000_000


def downsampling_summary(metrics: DataFrame, percentile_rows: int = PERCENTILE_ROWS) -> DataFrame:
    """One row per interval: totals, ratios of totals, and exact quantiles over flights (the p95 offset is that of the flights' p95)."""
    metrics = materialise(metrics)
    kept = F.sum("sampled_points") / F.sum("full_points")
    quantiles = {
        "sampled_points_median": ("sampled_points", 0.5), "hausdorff_median_km": ("hausdorff_km", 0.5), "hausdorff_p95_km": ("hausdorff_km", 0.95),
        "path_length_abs_error_median_pct": ("path_length_abs_error_pct", 0.5), "path_length_abs_error_p95_pct": ("path_length_abs_error_pct", 0.95),
        "target_time_offset_median_sec": ("median_target_time_offset_sec", 0.5), "target_time_offset_p95_sec": ("p95_target_time_offset_sec", 0.95),
    }
    totals = metrics.groupBy("interval_sec").agg(
        F.count_distinct("flight_id").alias("flights"), F.sum("full_points").alias("full_points_total"), F.sum("sampled_points").alias("sampled_points_total"),
        (100.0 * kept).alias("retention_pct"), (100.0 * (1 - kept)).alias("point_reduction_pct"), F.max("hausdorff_km").alias("hausdorff_max_km"),
    )
    if metrics.count() <= percentile_rows:
        middle = metrics.groupBy("interval_sec").agg(*[F.percentile(c, F.lit(p)).alias(k) for k, (c, p) in quantiles.items()])
    else:
        middle = exact_quantiles(metrics, ["interval_sec"], quantiles)
    names = ["interval_sec", "flights", "full_points_total", "sampled_points_total", "sampled_points_median", "retention_pct", "point_reduction_pct", "hausdorff_median_km", "hausdorff_p95_km", "hausdorff_max_km", "path_length_abs_error_median_pct", "path_length_abs_error_p95_pct", "target_time_offset_median_sec", "target_time_offset_p95_sec"]
    return totals.join(middle, "interval_sec").select(*names)
