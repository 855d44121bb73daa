"""Queries on single trajectories: cleaning, quality, sampling, segments, arrivals, grids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators import arrivals, clean, grid, sampling
from wayline.operators.common import ensure_checkpoint_dir
from wayline.operators.spikes import reject_spikes
from wayline.plans.sql import C2, LEGS, MARKED, POSITIONS, QC, QC_SCREENED, SCREENED, SETS, arc, d, haversine
from wayline.sources.history import scan_history, write_history
from wayline.sources.netcdf import read_arrays, write_arrays
from wayline.sources.tables import flights, latest_file_per_key, positions, strict_seconds, table, utc_text

MIN_POINTS, INTERVALS = 60, [60, 120]


def rounded(name: str, digits: int = 6) -> Column:
    return F.round(name, digits).alias(name)


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.reject_repeats(clean.reject_rows(positions(spark, sf_dir), flights(spark, sf_dir)))


def valid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flight_id, t, lat, lon) of the rows that the row rules and the repeat rule leave."""
    return marked(spark, sf_dir).where("removal_reason = ''").select("flight_id", F.col("lastposupdate").alias("t"), "lat", "lon")


def leg_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean.legs(marked(spark, sf_dir).where("removal_reason = ''"))
    return out.where("gap_sec IS NOT NULL").select("flight_id", "event_id", "gap_sec", rounded("step_km"), F.round(F.col("step_km") * 1000 / F.col("gap_sec"), 4).alias("speed_mps"))


def reject_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).groupBy("removal_reason").agg(F.count("*").alias("points"))


def dedup_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).where("removal_reason = ''").select("flight_id", "event_id", "lastposupdate", "state_time", "lat", "lon")


def impossible_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean.legs(marked(spark, sf_dir).where("removal_reason = ''")).where("bad_leg")
    return out.groupBy("flight_id").agg(F.count("*").alias("bad_legs"), F.round(F.max("step_km"), 6).alias("longest_km"))


def spike_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_spikes(marked(spark, sf_dir)).select("flight_id", "event_id", "removal_reason")


def _qc(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.flight_qc(rows, flights(spark, sf_dir), MIN_POINTS)


def _shown(qc: DataFrame) -> DataFrame:
    return qc.select("flight_id", "raw_points", "clean_points", "removed_points", "max_gap_sec", "median_gap_sec", rounded("observed_duration_min"), rounded("start_distance_km"), rounded("end_distance_km"), "unresolved_jump_segments", "review_reason", "status")


def flight_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_qc(marked(spark, sf_dir), spark, sf_dir))


def flight_qc_screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_qc(reject_spikes(marked(spark, sf_dir)), spark, sf_dir))


def accepted_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _qc(marked(spark, sf_dir), spark, sf_dir).where("status = 'pass'").select("flight_id")


def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _qc(marked(spark, sf_dir), spark, sf_dir).where("status = 'review'").groupBy("review_reason").agg(F.count("*").alias("flights"))


def preparation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marked(spark, sf_dir)
    report = clean.preparation_report(rows, _qc(rows, spark, sf_dir), F.lit("CS3"))
    return report.select(*[F.to_json(c).alias(c) if c.endswith("reasons") else F.col(c) for c in report.columns])


def row_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marked(spark, sf_dir)
    kept, gone = rows.where("removal_reason = ''"), rows.where("removal_reason <> ''")
    n = lambda df, name: df.groupBy("flight_id").agg(F.count("*").alias(name))
    out = n(positions(spark, sf_dir), "all_rows").join(n(kept, "kept_rows"), "flight_id", "left").join(n(gone, "removed_rows"), "flight_id", "left").na.fill(0)
    return out.withColumn("lost_rows", F.col("all_rows") - F.col("kept_rows") - F.col("removed_rows"))


def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.path_lengths(valid_points(spark, sf_dir)).select("flight_id", "points", rounded("path_km"))


def downsample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.nearest_observations(valid_points(spark, sf_dir), INTERVALS[0]).select("flight_id", "k", "t", "offset_sec")


METRICS = ["sampled_path_km", "full_path_km", "hausdorff_km", "retention_pct", "path_length_abs_error_pct", "median_target_time_offset_sec", "p95_target_time_offset_sec", "max_target_time_offset_sec"]


def downsample_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.downsampling_metrics(valid_points(spark, sf_dir), INTERVALS)
    return out.select("interval_sec", "flight_id", "full_points", "sampled_points", *[rounded(c, 5) for c in METRICS])


def downsample_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.downsampling_summary(sampling.downsampling_metrics(valid_points(spark, sf_dir), INTERVALS))
    return out.select(*[rounded(c, 5) if t == "double" else F.col(c) for c, t in out.dtypes])


def gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals.segments(valid_points(spark, sf_dir))


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flights(spark, sf_dir)
    callsign = F.concat(F.lit(" cs"), (F.col("flight_id") % 7).cast("string"))
    return arrivals.valid_arrivals(f.select(callsign.alias("callsign"), F.upper("icao24").alias("icao24"), (F.col("start_unix") + 700).alias("firstseen"), (F.col("end_unix") - 500).alias("lastseen")))


def interval_join_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _arrivals(spark, sf_dir)
    points = positions(spark, sf_dir).withColumn("t", F.col("state_time")).drop("flight_id")
    return arrivals.arrival_checks(chosen, arrivals.arrival_points(chosen, points, 0.0, 1e15))


def latest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 10 == 0, "d0/note.txt").otherwise(F.concat(F.lit("d"), F.col("c_custkey") % 3, F.lit("/flight_K"), F.col("c_nationkey"), F.lit("_"), F.col("c_custkey"), F.lit(".csv")))
    return latest_file_per_key(c.select(name.alias("path")), r"^flight_([A-Z0-9]+)_\d+\.csv$")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    div = lambda n: F.floor(i / n)
    level = F.element_at(F.array(F.lit(300.0), F.lit(350.0), F.lit(500.0)), (div(4) % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select((i % 4).alias("valid_time"), level.alias("level"), (div(12) % 25).cast("double").alias("lat"), div(300).cast("double").alias("lon"), F.lit("v").alias("name"), "value")


def grid_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.thinned(grid.nearest_level(grid.exact_time(_grid(spark, sf_dir), "v", 1), 350.005), 1.0, 5).select("level", "lat", "lon", rounded("value"))


def grid_slice_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``grid_slice`` of array files: the grid is written as such, and the time and level asked for choose what is read of them."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/arrays/{uuid.uuid4().hex}"
    write_arrays(_grid(spark, sf_dir), folder, ["valid_time", "level", "lat", "lon"], "value")
    near = read_arrays(spark, folder, "value").where("valid_time = 1 AND level BETWEEN 349.995 AND 350.015 AND value IS NOT NULL").withColumn("name", F.lit("v"))
    return grid.thinned(grid.nearest_level(grid.exact_time(near, "v", 1), 350.005), 1.0, 5).select("level", "lat", "lon", rounded("value"))


def history_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of two planes in a span of time and a box, from a history written along the curve."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/history/{uuid.uuid4().hex}"
    write_history(positions(spark, sf_dir), folder, files=spark.sparkContext.defaultParallelism * 4)
    found = scan_history(spark, folder, ["a00001", "a00002"], 500_000.0, 1e8, (50.0, 0.0, 51.4, 8.5))
    return found.select("flight_id", "event_id", "icao24", "state_time", "lat", "lon")


def grid_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.accumulation(_grid(spark, sf_dir).where("level = 350"), "v", 1, 2).select("lat", "lon", rounded("value"))


def grid_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper end of a scale for each field, with NaN and null skipped."""
    rows = _grid(spark, sf_dir).withColumn("value", F.when(F.col("lat") % 5 == 1, float("nan")).when(F.col("lat") % 5 != 2, F.col("value")))
    return grid.colour_limit(rows, 2.0, 1.0).select(F.lit("fine").alias("scale"), "upper").unionByName(grid.colour_limit(rows, 500.0, 200.0).select(F.lit("coarse").alias("scale"), "upper"))


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' times as text, parsed to seconds without leniency, and written anew."""
    e = table(spark, sf_dir, "events").where("ts IS NOT NULL").select("event_id", F.concat(F.col("ts").cast("string"), F.lit("Z")).alias("time"))
    seconds = strict_seconds(e, "time")
    return e.select("event_id", seconds.alias("seconds"), utc_text(seconds).alias("utc"))


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON properties of the events, parsed and summed by type."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("parsed"), F.sum(k).alias("k_total"), F.max(k).alias("k_largest"))


def route_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = valid_points(spark, sf_dir)
    named = points.select(F.concat(F.lit("CS"), F.col("flight_id") % 7).alias("callsign"), F.format_string("flight_%d.csv", "flight_id").alias("source_file"), "t")
    return arrivals.route_manifest(named)


QUERIES = {f.__name__: f for f in (leg_geometry, reject_reason_counts, dedup_positions, impossible_legs, spike_screen, flight_qc, flight_qc_screened, accepted_flights, review_reasons, preparation_report, row_reconciliation, path_length, downsample_nearest, downsample_metrics, downsample_summary, gap_segments, interval_join_qa, latest_files, grid_slice, grid_slice_from_files, history_scan, grid_accumulation, grid_limits, event_times, event_properties, route_manifest)}

_SHOWN = "SELECT flight_id, raw_points, clean_points, removed_points, max_gap_sec, median_gap_sec, round(observed_duration_min, 6) AS observed_duration_min, round(start_distance_km, 6) AS start_distance_km, round(end_distance_km, 6) AS end_distance_km, unresolved_jump_segments, review_reason, CASE WHEN review_reason = '' THEN 'pass' ELSE 'review' END AS status FROM qc"
_PATH = f"SELECT flight_id, count(*) AS points, coalesce(sum({haversine('la', 'lo', 'lat', 'lon')}), 0) AS path_km FROM (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM {{}} WINDOW w AS (PARTITION BY {{}}flight_id ORDER BY t)) GROUP BY {{}}flight_id"
_SAMPLES = f"""{SETS},
span AS (SELECT flight_id, min(t) AS a, max(t) AS z FROM u GROUP BY flight_id),
every(interval_sec) AS (VALUES (60), (120)),
targets AS (SELECT interval_sec, flight_id, a, unnest(range(CAST(floor((z - a + 1e-9) / interval_sec) AS BIGINT) + 1)) AS k FROM span, every),
chosen AS (
  SELECT interval_sec, flight_id, k, a, min({{'off': abs(u.t - (a + k * CAST(interval_sec AS DOUBLE))), 't': u.t}}) AS m FROM targets JOIN u USING (flight_id) GROUP BY ALL
), picked AS (SELECT DISTINCT interval_sec, flight_id, m.t AS t FROM chosen UNION SELECT interval_sec, flight_id, a FROM span, every UNION SELECT interval_sec, flight_id, z FROM span, every),
s AS (SELECT interval_sec, u.* FROM u JOIN picked USING (flight_id, t)),
full_path AS ({_PATH.format("u", "", "")}),
part_path AS ({_PATH.format("s", "interval_sec, ", "interval_sec, ").replace("SELECT flight_id", "SELECT interval_sec, flight_id", 1)}),
forward AS (SELECT interval_sec, flight_id, max(c2) AS c2 FROM (SELECT interval_sec, flight_id, p.idx, min({C2}) AS c2 FROM u p JOIN s q USING (flight_id) GROUP BY ALL) GROUP BY ALL),
metrics AS (
  SELECT interval_sec, flight_id, f.points AS full_points, p.points AS sampled_points, p.path_km AS sampled_path_km, f.path_km AS full_path_km,
    {arc("c2")} AS hausdorff_km, {d(100)} * p.points / f.points AS retention_pct, CASE WHEN f.path_km > 0 THEN {d(100)} * abs(p.path_km - f.path_km) / f.path_km END AS path_length_abs_error_pct,
    median(m.off) AS median_target_time_offset_sec, quantile_cont(m.off, {d(0.95)}) AS p95_target_time_offset_sec, max(m.off) AS max_target_time_offset_sec
  FROM chosen JOIN forward USING (interval_sec, flight_id) JOIN part_path p USING (interval_sec, flight_id) JOIN full_path f USING (flight_id)
  GROUP BY interval_sec, flight_id, f.points, p.points, p.path_km, f.path_km, c2
)"""
_GRID = "grid AS (SELECT event_id % 4 AS valid_time, [CAST(300 AS DOUBLE), CAST(350 AS DOUBLE), CAST(500 AS DOUBLE)][CAST((event_id // 4) % 3 + 1 AS INTEGER)] AS level, CAST((event_id // 12) % 25 AS DOUBLE) AS lat, CAST(event_id // 300 AS DOUBLE) AS lon, value FROM events)"

SQL = {
    "history_scan": f"WITH {POSITIONS} SELECT flight_id, event_id, icao24, state_time, lat, lon FROM positions WHERE icao24 IN ('a00001', 'a00002') AND state_time BETWEEN 500000 AND 100000000 AND lat BETWEEN 50 AND {d(51.4)} AND lon BETWEEN 0 AND {d(8.5)}",
    "leg_geometry": f"WITH {MARKED}, {LEGS} SELECT flight_id, event_id, gap_sec, round(step_km, 6) AS step_km, round(step_km * 1000 / gap_sec, 4) AS speed_mps FROM legs WHERE gap_sec IS NOT NULL",
    "reject_reason_counts": f"WITH {MARKED} SELECT removal_reason, count(*) AS points FROM marked GROUP BY removal_reason",
    "dedup_positions": f"WITH {MARKED} SELECT flight_id, event_id, lastposupdate, state_time, lat, lon FROM marked WHERE removal_reason = ''",
    "impossible_legs": f"WITH {MARKED}, {LEGS} SELECT flight_id, count(*) AS bad_legs, round(max(step_km), 6) AS longest_km FROM legs WHERE step_km > {d(0.45)} * gap_sec + 2 GROUP BY flight_id",
    "spike_screen": f"WITH RECURSIVE {SCREENED} SELECT flight_id, event_id, removal_reason FROM marked",
    "flight_qc": f"WITH {QC} {_SHOWN}",
    "flight_qc_screened": f"WITH RECURSIVE {QC_SCREENED} {_SHOWN}",
    "accepted_flights": f"WITH {QC} SELECT flight_id FROM qc WHERE review_reason = ''",
    "review_reasons": f"WITH {QC} SELECT review_reason, count(*) AS flights FROM qc WHERE review_reason <> '' GROUP BY review_reason",
    "preparation_report": f"""WITH {QC}, reasons AS (SELECT removal_reason AS r, count(*) AS n FROM marked WHERE removal_reason <> '' GROUP BY ALL), reviews AS (SELECT review_reason AS r, count(*) AS n FROM qc WHERE review_reason <> '' GROUP BY ALL)
      SELECT count(*) AS raw_points, count(*) FILTER (WHERE removal_reason = '') AS clean_points, count(*) FILTER (WHERE removal_reason <> '') AS removed_points,
        count(*) FILTER (WHERE point_callsign = '') AS missing_callsign_rows, count(*) FILTER (WHERE point_callsign NOT IN ('', 'CS3')) AS unexpected_callsign_rows,
        (SELECT count(*) FROM qc) AS input_flights, (SELECT count(*) FROM qc WHERE review_reason = '') AS accepted_flights, (SELECT count(*) FROM qc WHERE review_reason <> '') AS review_flights,
        (SELECT CAST(coalesce(sum(clean_points), 0) AS BIGINT) FROM qc WHERE review_reason = '') AS accepted_points, (SELECT max(max_gap_sec) FROM qc WHERE review_reason = '') AS accepted_worst_gap_sec,
        (SELECT '{{' || coalesce(string_agg('"' || r || '":' || n, ',' ORDER BY r), '') || '}}' FROM reasons) AS removal_reasons, (SELECT '{{' || coalesce(string_agg('"' || r || '":' || n, ',' ORDER BY r), '') || '}}' FROM reviews) AS review_reasons
      FROM marked""",
    "row_reconciliation": f"WITH {MARKED} SELECT flight_id, count(*) AS all_rows, count(*) FILTER (WHERE removal_reason = '') AS kept_rows, count(*) FILTER (WHERE removal_reason <> '') AS removed_rows, CAST(0 AS BIGINT) AS lost_rows FROM marked GROUP BY flight_id",
    "path_length": f"WITH {SETS} SELECT flight_id, points, round(path_km, 6) AS path_km FROM ({_PATH.format('u', '', '')})",
    "downsample_nearest": f"WITH {_SAMPLES} SELECT flight_id, k, m.t AS t, m.off AS offset_sec FROM chosen WHERE interval_sec = 60",
    "downsample_metrics": f"WITH {_SAMPLES} SELECT interval_sec, flight_id, full_points, sampled_points, {', '.join(f'round({c}, 5) AS {c}' for c in METRICS)} FROM metrics",
    "downsample_summary": f"""WITH {_SAMPLES} SELECT interval_sec, count(DISTINCT flight_id) AS flights, CAST(sum(full_points) AS BIGINT) AS full_points_total, CAST(sum(sampled_points) AS BIGINT) AS sampled_points_total,
      round(median(sampled_points), 5) AS sampled_points_median, round({d(100)} * sum(sampled_points) / sum(full_points), 5) AS retention_pct, round({d(100)} * (1 - CAST(sum(sampled_points) AS DOUBLE) / sum(full_points)), 5) AS point_reduction_pct,
      {', '.join(f'round(quantile_cont({c}, {d(q)}), 5) AS {n}' for c, q, n in (('hausdorff_km', 0.5, 'hausdorff_median_km'), ('hausdorff_km', 0.95, 'hausdorff_p95_km'), ('path_length_abs_error_pct', 0.5, 'path_length_abs_error_median_pct'), ('path_length_abs_error_pct', 0.95, 'path_length_abs_error_p95_pct'), ('median_target_time_offset_sec', 0.5, 'target_time_offset_median_sec'), ('p95_target_time_offset_sec', 0.95, 'target_time_offset_p95_sec')))},
      round(max(hausdorff_km), 5) AS hausdorff_max_km FROM metrics GROUP BY interval_sec""",
    "gap_segments": f"""WITH {SETS}, cut AS (SELECT flight_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY flight_id ORDER BY t) > 60 THEN 1 ELSE 0 END AS new FROM u),
      numbered AS (SELECT flight_id, t, CAST(sum(new) OVER (PARTITION BY flight_id ORDER BY t) AS BIGINT) AS segment_id FROM cut)
      SELECT flight_id, segment_id, count(*) AS points, min(t) AS first_t, max(t) AS last_t FROM numbered GROUP BY flight_id, segment_id HAVING count(*) >= 2""",
    "interval_join_qa": f"""WITH {POSITIONS}, arrivals AS (SELECT 'CS' || (flight_id % 7) AS callsign, plane AS icao24, start_unix + 700 AS firstseen, end_unix - 500 AS lastseen FROM flights),
      joined AS (SELECT a.*, p.state_time AS t, p.lat, p.lon, p.lastposupdate, p.point_callsign FROM arrivals a JOIN positions p ON p.icao24 = a.icao24 AND p.state_time BETWEEN a.firstseen - 600 AND a.lastseen + 240 WHERE p.lat IS NOT NULL),
      counted AS (SELECT *, count(*) FILTER (WHERE point_callsign = callsign) OVER (PARTITION BY callsign, icao24, lastseen) AS matches FROM joined),
      kept AS (SELECT callsign, icao24, lastseen, t, lat, lon, min(lastposupdate) AS lastposupdate FROM counted WHERE matches < 3 OR point_callsign IN (callsign, '') GROUP BY ALL),
      n AS (SELECT callsign, icao24, lastseen, count(*) AS n, count(*) FILTER (WHERE t - lastposupdate BETWEEN 0 AND 15) AS ok FROM kept GROUP BY ALL)
      SELECT callsign, icao24, lastseen, coalesce(n, 0) AS matched_points, coalesce(ok, 0) AS ages_between_0_and_15s,
        CASE WHEN coalesce(n, 0) < 5 THEN 'INSUFFICIENT_POSITION_ROWS' WHEN ok < greatest(5, n * 8 // 10) THEN 'NEEDS_POSITION_AGE_QA' ELSE 'AGE_RANGE_PLAUSIBLE_CHECK_OTHER_QA' END AS status
      FROM arrivals LEFT JOIN n USING (callsign, icao24, lastseen)""",
    "latest_files": "SELECT 'K' || c_nationkey AS key, max('d' || (c_custkey % 3) || '/flight_K' || c_nationkey || '_' || c_custkey || '.csv') AS path, count(*) AS files FROM customer WHERE c_custkey % 10 <> 0 GROUP BY c_nationkey",
    "grid_slice": f"WITH {_GRID} SELECT level, lat, lon, round(value, 6) AS value FROM grid WHERE valid_time = 1 AND level = 350 AND lat % 5 = 0 AND lon % 5 = 0",
    "grid_limits": f"""WITH {_GRID}, top AS (SELECT max(value) AS v FROM grid WHERE lat % 5 NOT IN (1, 2))
      SELECT 'fine' AS scale, greatest({d(2)}, ceil(v)) AS upper FROM top UNION ALL SELECT 'coarse', greatest({d(500)}, ceil(v / 200) * 200) FROM top""",
    "event_times": "SELECT event_id, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS seconds, strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END || '+00:00' AS utc FROM events WHERE ts IS NOT NULL",
    "event_properties": "SELECT event_type, count(k) AS parsed, CAST(sum(k) AS BIGINT) AS k_total, max(k) AS k_largest FROM (SELECT event_type, CAST(props::JSON ->> 'k' AS BIGINT) AS k FROM events) GROUP BY event_type",
    "route_manifest": f"""WITH {SETS} SELECT 'CS' || (flight_id % 7) AS callsign, 'flight_' || flight_id || '.csv' AS source_file, count(*) AS plotted_points, strftime(make_timestamp(CAST(min(t) * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S+00:00') AS observed_first_utc,
      strftime(make_timestamp(CAST(max(t) * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S+00:00') AS observed_last_utc, FALSE AS position_age_verified FROM u GROUP BY flight_id HAVING count(*) >= 5""",
    "grid_accumulation": f"WITH {_GRID} SELECT a.lat, a.lon, round(CASE WHEN (b.value - a.value) * 1000 >= {d(0.1)} THEN (b.value - a.value) * 1000 END, 6) AS value FROM grid a JOIN grid b ON a.lat = b.lat AND a.lon = b.lon AND a.level = 350 AND b.level = 350 AND a.valid_time = 1 AND b.valid_time = 2",
}
SQL["grid_slice_from_files"] = SQL["grid_slice"]
