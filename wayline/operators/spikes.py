"""Short position spikes: bursts of few points that no aircraft could reach from the points around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.geo import haversine_km
from wayline.operators.clean import ORDER, SPEED_KM_S, TOLERANCE_KM, legs
from wayline.operators.common import materialise

# Fixed values of the screening rule.
MAX_BURST, MAX_BRIDGE_SEC, PASSES = 5, 60.0, 10


def _beyond(a: Column, b: Column, speed: float, tolerance: float) -> Column:
    """Whether ``b`` is out of reach of the earlier point ``a``."""
    return haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]) > speed * (b["t"] - a["t"]) + tolerance


def with_first_burst(points: DataFrame, speed: float = SPEED_KM_S, tolerance: float = TOLERANCE_KM, max_burst: int = MAX_BURST, max_bridge: float = MAX_BRIDGE_SEC) -> DataFrame:
    """``points`` with ``burst``, the ids of the points of their flight's first burst, or null.

    A burst of 1 to ``max_burst`` points lies between two anchors that are at most ``max_bridge``
    seconds apart and within reach of each other, while every point of it is out of reach of both.
    The earliest left anchor wins, then the shortest burst; first and last points are in none. One
    sort by flight brings the next points to every row, and only rows before a leg beyond reach go on.
    """
    flight = Window.partitionBy("flight_id")
    w = flight.orderBy(*ORDER)
    row = F.struct(F.col("lastposupdate").alias("t"), "lat", "lon", "event_id")
    near = points.withColumns({"__left": row, "__ahead": F.array(*[F.lead(row, k).over(w) for k in range(1, max_burst + 2)])})
    left, ahead = F.col("__left"), F.filter("__ahead", lambda x: x.isNotNull())

    def fits(size: Column) -> Column:
        right = F.element_at(ahead, size + 1)
        bridge = right["t"] - left["t"]
        inner = F.forall(F.slice(ahead, F.lit(1), size), lambda x: _beyond(left, x, speed, tolerance) & _beyond(x, right, speed, tolerance))
        return (bridge > 0) & (bridge <= max_bridge) & ~_beyond(left, right, speed, tolerance) & inner

    some = F.when(F.size(ahead) > 1, F.sequence(F.lit(1), F.size(ahead) - 1)).otherwise(F.array().cast("array<int>"))
    size = F.when(_beyond(left, F.col("__ahead")[0], speed, tolerance), F.try_element_at(F.filter(some, fits), F.lit(1)))
    near = near.withColumn("__size", size)
    own = F.when(F.col("__size").isNotNull(), F.struct(F.struct(*ORDER).alias("at"), F.transform(F.slice("__ahead", F.lit(1), F.col("__size")), lambda x: x["event_id"]).alias("burst")))
    return near.withColumn("burst", F.min(own).over(flight)["burst"]).drop("__left", "__ahead", "__size")


def find_spikes(points: DataFrame, passes: int = PASSES, **rule: float) -> DataFrame:
    """(flight_id, event_id) of the points of at most ``passes`` bursts a flight, one a pass; the others close ranks after each.

    ``points`` has flight_id, the columns of ``ORDER``, lat and lon, without nulls. Only flights with a
    leg beyond reach enter, and only those that had a burst in one pass enter the next.
    """
    suspect = legs(points).where("bad_leg").select("flight_id").distinct()
    left = points.select("flight_id", *ORDER, "lat", "lon").join(suspect, "flight_id", "left_semi")
    found = points.select("flight_id", "event_id").limit(0)
    for _ in range(passes):
        judged = with_first_burst(left, **rule).where("burst IS NOT NULL")
        judged = materialise(judged.withColumn("__gone", F.array_contains("burst", F.col("event_id"))).drop("burst"))
        if not judged.take(1):
            break
        found = found.unionByName(judged.where("__gone").select("flight_id", "event_id"))
        left = judged.where("NOT __gone").drop("__gone")
    return found


def reject_spikes(marked: DataFrame) -> DataFrame:
    """``marked`` with ``short_position_spike`` as the reason of the valid rows that :func:`find_spikes` finds."""
    spikes = find_spikes(marked.where("removal_reason = ''"))
    out = marked.join(spikes.withColumn("__spike", F.lit(True)), ["flight_id", "event_id"], "left")
    return out.withColumn("removal_reason", F.when(F.col("__spike") & (F.col("removal_reason") == ""), "short_position_spike").otherwise(F.col("removal_reason"))).drop("__spike")
