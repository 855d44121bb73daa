"""Review of the trajectories that are noise in every setting: which medoid is nearest, and where they part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators import cluster, hausdorff
from wayline.sources.tables import utc_text


def persistent_noise_review(points: DataFrame, matrix: DataFrame, labels: DataFrame, grid: DataFrame, centres: DataFrame) -> DataFrame:
    """One row per id that is noise in ``labels`` and in every setting of ``grid``, in the order of its first time.

    ``points`` is (flight_id, t, lat, lon). The witness is the candidate's point of the pair that makes
    the distance to the nearest medoid; its time is given as text and in minutes before the last
    observation. The distances are made anew from the points, and the job stops if one is not that
    of the matrix. Without candidates or medoids there are no rows.
    """
    wanted = labels.where("label = -1").select("i").join(cluster.persistent_noise(grid), "i", "left_semi")
    near = cluster.noise_ranking(matrix, labels, centres).join(wanted, "i", "left_semi")
    near = near.select(F.col("i").alias("flight_id"), "nearest_cluster", F.col("nearest_medoid").alias("medoid_flight_id"), F.col("distance_km").alias("__expected"))
    found = hausdorff.witnesses(near.select(F.col("flight_id").alias("a"), F.col("medoid_flight_id").alias("b")), points)
    w = Window.partitionBy("flight_id").orderBy("t")
    own = points.join(near.select("flight_id"), "flight_id", "left_semi").withColumn("gap", F.col("t") - F.lag("t").over(w))
    own = own.groupBy("flight_id").agg(F.max("gap").alias("max_position_gap_sec"), F.count("*").alias("point_count"), F.min("t").alias("__first"), F.max("t").alias("__last"))
    forward = F.col("direction") == "a_to_b"
    mine = lambda c: F.when(forward, F.col(f"source_{c}")).otherwise(F.col(f"target_{c}"))
    joined = near.join(own, "flight_id").join(found, F.col("flight_id") == F.col("flight_a"))
    joined = joined.withColumn("__ok", F.assert_true(F.abs(F.col("hausdorff_km") - F.col("__expected")) <= 1e-7, F.lit("the points do not give the distance of the matrix"))).where("__ok IS NULL")
    return joined.orderBy("__first", "flight_id").select(
        F.substring(utc_text(F.col("__first")), 1, 10).alias("date"), "flight_id", "nearest_cluster", "medoid_flight_id", "hausdorff_km",
        F.col("directed_a_to_b_km").alias("candidate_to_medoid_max_km"), F.col("directed_b_to_a_km").alias("medoid_to_candidate_max_km"),
        F.when(forward, "candidate_to_medoid").otherwise("medoid_to_candidate").alias("controlling_direction"),
        "max_position_gap_sec", "point_count", ((F.col("__last") - F.col("__first")) / 60).alias("observed_duration_min"),
        mine("lat").alias("candidate_witness_latitude"), mine("lon").alias("candidate_witness_longitude"), utc_text(mine("t")).alias("candidate_witness_utc"),
        ((F.col("__last") - mine("t")) / 60).alias("witness_minutes_before_last_observation"),
    )
