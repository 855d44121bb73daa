"""Queries on sets of trajectories: distances, pairs, clustering, medoids, outliers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators import clean, cluster, hausdorff, lineage, metric, review
from wayline.operators.common import materialise, ranked
from wayline.operators.matrix_store import MatrixStore, stored_matrix
from wayline.plans.sql import C2, LANES, MARKED, MATRIX, SETS, arc, d
from wayline.plans.tracks import rounded, valid_points
from wayline.sources.tables import flights, utc_text

REQUESTED = (10, 5)
EPSILON_KM, TOP = 60.0, 10


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(valid_points(spark, sf_dir))


def _matrix(points: DataFrame, sf_dir: str) -> DataFrame:
    return stored_matrix(points, hashlib.md5(sf_dir.encode()).hexdigest())


def _bounded(points: DataFrame, sf_dir: str, by_sets: Callable[[metric.Sets], DataFrame], by_matrix: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What bounds answer without the matrix; only sets too long for a task need all of it."""
    try:
        sets = metric.Sets(points)
    except metric.LongSets:
        return by_matrix(_matrix(points, sf_dir))
    return by_sets(sets)


def _top(points: DataFrame, sf_dir: str) -> DataFrame:
    return materialise(_bounded(points, sf_dir, lambda sets: metric.top_pairs(sets, TOP), lambda matrix: hausdorff.top_pairs(matrix, TOP)))


def _lanes(points: DataFrame) -> DataFrame:
    """A given clustering: every seventh flight is noise, the others go by lane."""
    i = F.col("flight_id")
    return points.select("flight_id").distinct().select(i.alias("i"), F.when(i % 7 == 3, -1).otherwise(i % 5).cast("long").alias("label"))


def _label_grid(points: DataFrame) -> DataFrame:
    """Four given settings: every seventh flight is noise in some of them, the others go by lane."""
    i, k = F.col("i"), F.col("k")
    every = points.select(F.col("flight_id").alias("i")).distinct().withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    label = F.when((i % 7 == 3) & ((i + k) % 8 != 0), -1).otherwise(i % 5).cast("long")
    return every.select((5 * (k + 1)).alias("mcs"), F.lit(5).alias("ms"), "i", label.alias("label"))


_KM = ["directed_a_to_b_km", "directed_b_to_a_km", "hausdorff_km"]


def hausdorff_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(_points(spark, sf_dir), sf_dir).select("a", "b", *[rounded(c, 5) for c in _KM])


def matrix_after_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix once flight 7 has moved and flight 11 is gone: only pairs with flight 7 are compared anew."""
    points = _points(spark, sf_dir)
    store = MatrixStore(spark, hashlib.md5(f"{sf_dir} changed".encode()).hexdigest())
    store.update(points)
    i = F.col("flight_id")
    matrix, _ = store.update(materialise(points.where(i != 11).withColumn("lat", F.when(i == 7, F.col("lat") + 0.25).otherwise(F.col("lat")))))
    return matrix.select("a", "b", *[rounded(c, 5) for c in _KM])


def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hausdorff.pair_statistics(_matrix(_points(spark, sf_dir), sf_dir)).select("pairs", *[rounded(c, 5) for c in ("min_km", "median_km", "p95_km", "max_km")])


def top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(_points(spark, sf_dir), sf_dir).select("rank", "a", "b", rounded("hausdorff_km", 5))


def top_pair_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hausdorff.appearances(_top(_points(spark, sf_dir), sf_dir))


def hausdorff_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    out = hausdorff.witnesses(_top(points, sf_dir), points)
    return out.select("flight_a", "flight_b", "direction", rounded("hausdorff_km", 5), "source_index", "target_index", "source_lat", "source_lon", "target_lat", "target_lon")


def matrix_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return hausdorff.matrix_violations(_matrix(points, sf_dir), points.select("flight_id").distinct().count())


def id_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of ids by number against their order as text."""
    ids = valid_points(spark, sf_dir).select("flight_id").distinct()
    rank = lambda key: ranked(ids, key, name="matrix_index")
    out = lineage.id_alignment(rank(F.col("flight_id")), rank(F.col("flight_id").cast("string")))
    return out.withColumn("matrix_index", F.col("matrix_index").cast("int"))


def core_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _bounded(_points(spark, sf_dir), sf_dir, lambda sets: metric.core_distances(sets, [1, 5]), lambda matrix: cluster.core_distances(matrix, [1, 5]))
    return out.select("ms", "i", rounded("core", 5))


def mutual_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = _matrix(_points(spark, sf_dir), sf_dir)
    return cluster.mutual_reachability(matrix, cluster.core_distances(matrix, [5])).select("ms", "i", "j", rounded("w", 5))


def spanning_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = _matrix(_points(spark, sf_dir), sf_dir)
    return cluster.spanning_edges(cluster.mutual_reachability(matrix, cluster.core_distances(matrix, [5]))).select("ms", "i", "j", rounded("w", 5))


def _fitted(spark: SparkSession, sf_dir: str, sweep: bool = True) -> DataFrame:
    points = _points(spark, sf_dir)
    n = points.select("flight_id").distinct().count()
    return materialise(cluster.hdbscan(_matrix(points, sf_dir), cluster.settings_grid(n, REQUESTED) if sweep else [REQUESTED]))


def hdbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir, sweep=False)


def parameter_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.sweep(_fitted(spark, sf_dir))


def noise_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.noise_fraction(_fitted(spark, sf_dir))


def settings_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings for a tenth of the flights, with (12, 7) requested."""
    n = valid_points(spark, sf_dir).select("flight_id").distinct().count() // 10
    return spark.createDataFrame(cluster.settings_grid(n, (12, 7)), "mcs int, ms int")


def given_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.sweep(_label_grid(valid_points(spark, sf_dir)))


def given_noise_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.noise_fraction(_label_grid(valid_points(spark, sf_dir)))


def persistent_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.persistent_noise(_label_grid(valid_points(spark, sf_dir)))


def _medoids(points: DataFrame, sf_dir: str) -> DataFrame:
    lanes = _lanes(points)
    return _bounded(points, sf_dir, lambda sets: metric.medoids(sets, lanes), lambda matrix: cluster.medoids(matrix, lanes))


def _to_medoids(points: DataFrame, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The medoids of the lanes, and a matrix that has the distances of the noise to them."""
    lanes = materialise(_lanes(points))
    try:
        sets = metric.Sets(points)
    except metric.LongSets:
        matrix = _matrix(points, sf_dir)
        return materialise(cluster.medoids(matrix, lanes)), matrix
    centres = materialise(metric.medoids(sets, lanes))
    return centres, materialise(metric.to_centres(sets, lanes.where("label = -1"), centres))


def noise_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    centres, matrix = _to_medoids(points, sf_dir)
    out = cluster.noise_candidates(matrix, _lanes(points), _label_grid(points), centres)
    return out.select("i", "noise_fraction", "nearest_medoid", "nearest_cluster", rounded("distance_km", 5))


def persistent_noise_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    centres, matrix = _to_medoids(points, sf_dir)
    out = review.persistent_noise_review(points, matrix, _lanes(points), _label_grid(points), centres)
    return out.select(*[rounded(c, 5) if c.endswith(("_km", "_min", "_observation")) else F.col(c) for c in out.columns])


def key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights of the list without a valid point, and the other way round."""
    return clean.key_differences(flights(spark, sf_dir), valid_points(spark, sf_dir), "flight_id")


def labelled_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given clustering with the date of each flight's start, one row a flight."""
    dates = flights(spark, sf_dir).select(F.col("flight_id").alias("i"), F.substring(utc_text(F.col("start_unix")), 1, 10).alias("date"))
    return clean.validated_join(_lanes(valid_points(spark, sf_dir)), dates, "i").select("i", "label", "date")


def linkage_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    ids = points.select(F.col("flight_id").alias("i")).distinct()
    return _bounded(points, sf_dir, lambda sets: metric.linkage_cut(sets, EPSILON_KM), lambda matrix: cluster.linkage_cut(matrix, ids, EPSILON_KM))


def cluster_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return _medoids(points, sf_dir).select("label", "medoid", "flights", rounded("median_distance_to_medoid_km", 5), rounded("max_distance_to_medoid_km", 5))


def noise_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    centres, matrix = _to_medoids(points, sf_dir)
    return cluster.noise_ranking(matrix, _lanes(points), centres).select("i", "nearest_medoid", "nearest_cluster", rounded("distance_km", 5))


def core_distance_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``core_distance`` without the matrix."""
    return metric.core_distances(metric.Sets(_points(spark, sf_dir)), [1, 5]).select("ms", "i", rounded("core", 5))


def linkage_cut_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``linkage_cut`` without the matrix."""
    return metric.linkage_cut(metric.Sets(_points(spark, sf_dir)), EPSILON_KM)


def top_pairs_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``top_pairs`` without the matrix."""
    return metric.top_pairs(metric.Sets(_points(spark, sf_dir)), TOP).select("rank", "a", "b", rounded("hausdorff_km", 5))


def cluster_medoids_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cluster_medoids`` without the matrix."""
    points = _points(spark, sf_dir)
    return metric.medoids(metric.Sets(points), _lanes(points)).select("label", "medoid", "flights", rounded("median_distance_to_medoid_km", 5), rounded("max_distance_to_medoid_km", 5))


QUERIES = {f.__name__: f for f in (matrix_after_change, core_distance_bounded, linkage_cut_bounded, top_pairs_bounded, cluster_medoids_bounded, hausdorff_pairs, pair_stats, top_pairs, top_pair_appearances, hausdorff_witness, matrix_invariants, id_alignment, core_distance, mutual_reachability, spanning_tree, hdbscan_labels, parameter_sweep, noise_fraction, settings_grid, given_sweep, given_noise_fraction, persistent_noise, linkage_cut, cluster_medoids, noise_ranking, noise_candidates, persistent_noise_review, key_differences, labelled_flights)}

_TOP = f"top AS (SELECT a, b, hausdorff_km, row_number() OVER (ORDER BY hausdorff_km DESC, a, b) AS rank FROM matrix QUALIFY rank <= {TOP})"
_CORE = f"core AS (SELECT 5 AS ms, i, d AS core FROM sym QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 4 UNION ALL SELECT 1, i, {d(0)} FROM ids)"

_REACH = "SELECT 5 AS ms, a AS i, b AS j, greatest(hausdorff_km, p.core, q.core) AS w FROM matrix JOIN core p ON p.i = a AND p.ms = 5 JOIN core q ON q.i = b AND q.ms = 5"
_GRID = """grid AS (SELECT 5 * (k + 1) AS mcs, 5 AS ms, i, CASE WHEN i % 7 = 3 AND (i + k) % 8 <> 0 THEN -1 ELSE i % 5 END AS label FROM (SELECT DISTINCT flight_id AS i FROM u), range(4) t(k)),
fractions AS (SELECT i, count(*) AS settings, count(*) FILTER (WHERE label = -1) AS noise_count FROM grid GROUP BY i)"""
_RANKED = "ranking AS (SELECT labels.i, medoid, medoids.label AS cluster, d FROM labels JOIN sym ON sym.i = labels.i JOIN medoids ON medoid = sym.j WHERE labels.label = -1 QUALIFY row_number() OVER (PARTITION BY labels.i ORDER BY d, medoid) = 1)"
_UTC = "strftime(make_timestamp(CAST({} * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S+00:00')"

_CHANGED = MATRIX.replace("FROM marked WHERE removal_reason = ''", f"FROM (SELECT * REPLACE (CASE WHEN flight_id = 7 THEN lat + {d(0.25)} ELSE lat END AS lat) FROM marked WHERE flight_id <> 11) marked WHERE removal_reason = ''")

SQL = {
    "matrix_after_change": f"WITH {_CHANGED} SELECT a, b, {', '.join(f'round({c}, 5) AS {c}' for c in _KM)} FROM matrix",
    "hausdorff_pairs": f"WITH {MATRIX} SELECT a, b, {', '.join(f'round({c}, 5) AS {c}' for c in _KM)} FROM matrix",
    "pair_stats": f"WITH {MATRIX} SELECT count(*) AS pairs, round(min(hausdorff_km), 5) AS min_km, round(median(hausdorff_km), 5) AS median_km, round(quantile_cont(hausdorff_km, {d(0.95)}), 5) AS p95_km, round(max(hausdorff_km), 5) AS max_km FROM matrix",
    "top_pairs": f"WITH {MATRIX}, {_TOP} SELECT CAST(rank AS INTEGER) AS rank, a, b, round(hausdorff_km, 5) AS hausdorff_km FROM top",
    "top_pair_appearances": f"WITH {MATRIX}, {_TOP} SELECT flight_id, count(*) AS top_pair_appearances FROM (SELECT a AS flight_id FROM top UNION ALL SELECT b FROM top) GROUP BY flight_id",
    "hausdorff_witness": f"""WITH {MATRIX}, {_TOP}, sides AS (SELECT a, b, 'a_to_b' AS direction, a AS s, b AS t FROM top UNION ALL SELECT a, b, 'b_to_a', b, a FROM top),
      closest AS (SELECT a, b, direction, p.idx AS source_index, p.lat AS source_lat, p.lon AS source_lon, min({{'c2': {C2}, 'k': q.idx, 'lat': q.lat, 'lon': q.lon}}) AS m FROM sides JOIN u p ON p.flight_id = sides.s JOIN u q ON q.flight_id = sides.t GROUP BY ALL),
      farthest AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY m.c2 DESC, direction, source_index) AS r FROM closest)
      SELECT a AS flight_a, b AS flight_b, direction, round({arc("m.c2")}, 5) AS hausdorff_km, CAST(source_index AS INTEGER) AS source_index, CAST(m.k AS INTEGER) AS target_index, source_lat, source_lon, m.lat AS target_lat, m.lon AS target_lon FROM farthest WHERE r = 1""",
    "matrix_invariants": f"""WITH {MATRIX}, ids AS (SELECT count(DISTINCT flight_id) AS n FROM u)
      SELECT CAST(any_value(n) * (any_value(n) - 1) // 2 - count(*) AS BIGINT) AS missing_pairs, count(*) - count(DISTINCT (a, b)) AS repeated_pairs, count(*) FILTER (WHERE a >= b) AS unordered_pairs,
        count(*) FILTER (WHERE hausdorff_km IS NULL OR NOT isfinite(hausdorff_km) OR hausdorff_km < 0) AS bad_distances, count(*) FILTER (WHERE abs(hausdorff_km - greatest(directed_a_to_b_km, directed_b_to_a_km)) > 1e-9) AS asymmetric FROM matrix, ids""",
    "id_alignment": f"WITH {SETS}, ids AS (SELECT DISTINCT flight_id FROM u), n AS (SELECT flight_id, row_number() OVER (ORDER BY flight_id) - 1 AS x, row_number() OVER (ORDER BY CAST(flight_id AS VARCHAR)) - 1 AS y FROM ids) SELECT CAST(p.x AS INTEGER) AS matrix_index, p.flight_id AS \"left\", q.flight_id AS \"right\" FROM n p JOIN n q ON p.x = q.y WHERE p.flight_id <> q.flight_id",
    "core_distance": f"WITH {LANES}, {_CORE} SELECT ms, i, round(core, 5) AS core FROM core",
    "mutual_reachability": f"WITH {LANES}, {_CORE} SELECT p.ms, a AS i, b AS j, round(greatest(hausdorff_km, p.core, q.core), 5) AS w FROM matrix JOIN core p ON p.i = a AND p.ms = 5 JOIN core q ON q.i = b AND q.ms = 5",
    "spanning_tree": f"""WITH RECURSIVE {LANES}, {_CORE}, edges AS MATERIALIZED ({_REACH}),
      tree(inside, e) AS (
        SELECT [min(i)], CAST(NULL AS STRUCT(w DOUBLE, i BIGINT, j BIGINT)) FROM edges
        UNION ALL
        SELECT list_append(inside, CASE WHEN list_contains(inside, e.i) THEN e.j ELSE e.i END), e FROM (
          SELECT inside, min({{'w': w, 'i': edges.i, 'j': edges.j}}) AS e FROM tree JOIN edges ON list_contains(inside, edges.i) <> list_contains(inside, edges.j) GROUP BY inside)
      ) SELECT 5 AS ms, e.i AS i, e.j AS j, round(e.w, 5) AS w FROM tree WHERE e IS NOT NULL""",
    "settings_grid": f"""WITH {SETS}, n AS (SELECT count(DISTINCT flight_id) // 10 AS n FROM u)
      SELECT c AS mcs, s AS ms FROM (VALUES (5), (10), (15), (20), (30)) x(c), (VALUES (5), (10), (15)) y(s), n WHERE c <= n AND s <= n UNION SELECT 12, 7""",
    "given_sweep": f"""WITH {SETS}, {_GRID}, sized AS (SELECT mcs, ms, label, count(*) AS n FROM grid GROUP BY ALL)
      SELECT mcs, ms, count(*) FILTER (WHERE label >= 0) AS clusters, CAST(coalesce(sum(n) FILTER (WHERE label < 0), 0) AS BIGINT) AS noise_flights, {d(100)} * coalesce(sum(n) FILTER (WHERE label < 0), 0) / sum(n) AS noise_percent,
        '{{' || coalesce(string_agg('"' || label || '":' || n, ',' ORDER BY label) FILTER (WHERE label >= 0), '') || '}}' AS cluster_sizes FROM sized GROUP BY mcs, ms""",
    "given_noise_fraction": f"WITH {SETS}, {_GRID} SELECT i, settings, noise_count, noise_count / settings AS noise_fraction FROM fractions",
    "persistent_noise": f"WITH {SETS}, {_GRID} SELECT i FROM fractions WHERE noise_count = settings",
    "noise_candidates": f"WITH {LANES}, {_GRID}, {_RANKED} SELECT i, noise_count / settings AS noise_fraction, medoid AS nearest_medoid, cluster AS nearest_cluster, round(d, 5) AS distance_km FROM labels JOIN fractions USING (i) LEFT JOIN ranking USING (i) WHERE label = -1",
    "persistent_noise_review": f"""WITH {LANES}, {_GRID}, {_RANKED},
      wanted AS (SELECT i, medoid, cluster FROM ranking JOIN fractions USING (i) WHERE noise_count = settings),
      sides AS (SELECT *, 'candidate_to_medoid' AS direction, i AS own_id, medoid AS other_id FROM wanted UNION ALL SELECT *, 'medoid_to_candidate', medoid, i FROM wanted),
      closest AS (SELECT i, medoid, cluster, direction, p.idx, p.t, p.lat, p.lon, min({{'c2': {C2}, 'k': q.idx, 't': q.t, 'lat': q.lat, 'lon': q.lon}}) AS m FROM sides JOIN u p ON p.flight_id = own_id JOIN u q ON q.flight_id = other_id GROUP BY ALL),
      one AS (SELECT *, CASE WHEN direction = 'candidate_to_medoid' THEN {{'t': t, 'lat': lat, 'lon': lon}} ELSE {{'t': m.t, 'lat': m.lat, 'lon': m.lon}} END AS mine FROM closest QUALIFY row_number() OVER (PARTITION BY i, direction ORDER BY m.c2 DESC, idx) = 1),
      won AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY i ORDER BY m.c2 DESC, direction) = 1),
      own AS (SELECT flight_id AS i, max(gap) AS gap, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM (SELECT flight_id, t, t - lag(t) OVER (PARTITION BY flight_id ORDER BY t) AS gap FROM u) GROUP BY flight_id)
      SELECT left({_UTC.format("first_t")}, 10) AS date, won.i AS flight_id, won.cluster AS nearest_cluster, won.medoid AS medoid_flight_id, round({arc("won.m.c2")}, 5) AS hausdorff_km,
        round({arc("f.m.c2")}, 5) AS candidate_to_medoid_max_km, round({arc("b.m.c2")}, 5) AS medoid_to_candidate_max_km, won.direction AS controlling_direction, gap AS max_position_gap_sec, n AS point_count, round((last_t - first_t) / 60, 5) AS observed_duration_min,
        won.mine.lat AS candidate_witness_latitude, won.mine.lon AS candidate_witness_longitude, {_UTC.format("won.mine.t")} AS candidate_witness_utc, round((last_t - won.mine.t) / 60, 5) AS witness_minutes_before_last_observation
      FROM won JOIN own USING (i) JOIN one f ON f.i = won.i AND f.direction = 'candidate_to_medoid' JOIN one b ON b.i = won.i AND b.direction = 'medoid_to_candidate'""",
    "key_differences": f"WITH {MARKED}, valid AS (SELECT DISTINCT flight_id FROM marked WHERE removal_reason = '') SELECT flight_id, 'left' AS side FROM flights ANTI JOIN valid USING (flight_id) UNION ALL SELECT flight_id, 'right' FROM valid ANTI JOIN flights USING (flight_id)",
    "labelled_flights": f"WITH {SETS} SELECT flight_id AS i, CASE WHEN flight_id % 7 = 3 THEN -1 ELSE flight_id % 5 END AS label, left({_UTC.format('start_unix')}, 10) AS date FROM flights WHERE flight_id IN (SELECT flight_id FROM u)",
    "linkage_cut": f"WITH RECURSIVE {LANES}, reach(i, j) AS (SELECT i, i FROM ids UNION SELECT reach.i, sym.j FROM reach JOIN sym ON reach.j = sym.i AND sym.d <= {EPSILON_KM}) SELECT i, min(j) AS component FROM reach GROUP BY i",
    "cluster_medoids": f"WITH {LANES} SELECT m.label, medoid, flights, round(median(d), 5) AS median_distance_to_medoid_km, round(max(d), 5) AS max_distance_to_medoid_km FROM medoids m JOIN within w ON w.label = m.label AND w.i = medoid GROUP BY ALL",
    "noise_ranking": f"WITH {LANES} SELECT labels.i, medoid AS nearest_medoid, medoids.label AS nearest_cluster, round(d, 5) AS distance_km FROM labels JOIN sym ON sym.i = labels.i JOIN medoids ON medoid = sym.j WHERE labels.label = -1 QUALIFY row_number() OVER (PARTITION BY labels.i ORDER BY d, medoid) = 1",
}
SQL |= {f"{name}_bounded": SQL[name] for name in ("core_distance", "linkage_cut", "top_pairs", "cluster_medoids")}
