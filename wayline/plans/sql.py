"""Common table expressions of the oracle: positions, marked positions, quality, point sets and their distances."""


def d(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)"
    return f"(2 * {d(6371.0088)} * asin(sqrt(least({d(1)}, greatest({d(0)}, {h})))))"


def arc(c2: str) -> str:
    return f"(2 * {d(6371.0088)} * asin(least({d(1)}, sqrt({c2}) / 2)))"


POSITIONS = f"""
e AS (
  SELECT user_id AS flight_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS DOUBLE) AS rn,
         CAST(count(*) OVER (PARTITION BY user_id) AS DOUBLE) AS n FROM events WHERE user_id IS NOT NULL
), g AS (SELECT *, CASE WHEN n > 1 THEN rn / (n - 1) ELSE {d(0)} END AS f FROM e),
b AS (
  SELECT flight_id, event_id,
    CASE WHEN event_id % 109 <> 0 AND flight_id % 50 <> 13 THEN CASE WHEN event_id % 97 = 0 THEN {d(20)} ELSE
      {d(51.4706)} - {d(1.4326)} * f + CAST(flight_id % 5 - 2 AS DOUBLE) * {d(0.6)} * f * (1 - f) + CAST((event_id * 7919) % 1000 - 500 AS DOUBLE) / {d(100000)} END END AS lat,
    CASE WHEN event_id % 97 = 0 THEN {d(106)} ELSE {d(-0.4619)} + {d(9.0241)} * f + CAST((event_id * 104729) % 1000 - 500 AS DOUBLE) / {d(100000)} END AS lon,
    CAST(flight_id AS DOUBLE) * {d(100000)} + {d(25)} * rn + CASE WHEN flight_id % 10 = 0 AND rn * 2 > n THEN {d(40)} ELSE {d(0)} END
      - CASE WHEN event_id % 83 = 0 AND rn > 0 THEN {d(25)} ELSE {d(0)} END AS lastposupdate,
    CASE WHEN event_id % 89 = 0 THEN {d(20)} ELSE CAST(event_id % 4 AS DOUBLE) END AS age FROM g
), positions AS (
  SELECT *, lastposupdate + age AS state_time, lastposupdate + age - CASE WHEN event_id % 107 = 0 THEN {d(20)} ELSE CAST(event_id % 3 AS DOUBLE) END AS lastcontact,
    CASE WHEN event_id % 103 = 0 THEN NULL WHEN event_id % 101 = 0 THEN 'zz' ELSE 'a0000' || (flight_id % 7) END AS icao24,
    CASE WHEN event_id % 11 <> 0 THEN 'CS' || (flight_id % 7) ELSE '' END AS point_callsign FROM b
), flights AS (
  SELECT user_id AS flight_id, 'a0000' || (user_id % 7) AS plane, CAST(user_id AS DOUBLE) * {d(100000)} AS start_unix,
    CAST(user_id AS DOUBLE) * {d(100000)} + CAST(count(*) AS DOUBLE) * {d(25)} + {d(10)} AS end_unix FROM events WHERE user_id IS NOT NULL GROUP BY user_id
)"""

MARKED = f"""{POSITIONS},
judged AS (
  SELECT p.*, CASE
    WHEN lat IS NULL OR lat NOT BETWEEN -90 AND 90 OR lon NOT BETWEEN -180 AND 180 THEN 'invalid_coordinate'
    WHEN state_time - lastposupdate NOT BETWEEN 0 AND 15 THEN 'stale_or_invalid_position_time'
    WHEN state_time - lastcontact NOT BETWEEN 0 AND 15 THEN 'stale_or_invalid_contact_time'
    WHEN icao24 IS NULL OR icao24 <> plane THEN 'aircraft_mismatch'
    WHEN state_time NOT BETWEEN start_unix AND end_unix + 1 THEN 'outside_flight_interval' ELSE '' END AS first_reason
  FROM positions p JOIN flights USING (flight_id)
), marked AS (
  SELECT *, CASE WHEN first_reason = '' AND row_number() OVER (PARTITION BY flight_id, lastposupdate, first_reason = '' ORDER BY state_time, event_id) > 1
    THEN 'duplicate_position_update' ELSE first_reason END AS removal_reason FROM judged
)"""

LEGS = f"""legs AS (
  SELECT *, lastposupdate - lag(lastposupdate) OVER w AS gap_sec, {haversine("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} AS step_km
  FROM marked WHERE removal_reason = '' WINDOW w AS (PARTITION BY flight_id ORDER BY lastposupdate, state_time, event_id)
)"""

_RULED = MARKED.replace("), marked AS (", "), ruled AS (")


def beyond(a: str, b: str) -> str:
    return f"{haversine(a + '.lat', a + '.lon', b + '.lat', b + '.lon')} > {d(0.45)} * ({b}.t - {a}.t) + 2"


#: The same with short spikes marked: a step takes a flight's first burst out, k counts (left anchor, size) pairs in order.
SCREENED = f"""{_RULED},
tracks AS (
  SELECT flight_id, list({{'e': event_id, 't': lastposupdate, 'lat': lat, 'lon': lon}} ORDER BY lastposupdate, state_time, event_id) AS p FROM ruled WHERE removal_reason = '' GROUP BY flight_id
), step(flight_id, pass, p, burst) AS (
  SELECT flight_id, 0, p, CAST([] AS BIGINT[]) FROM tracks
  UNION ALL
  SELECT flight_id, pass + 1, list_filter(p, lambda x: NOT list_contains(found, x.e)), found FROM (
    SELECT flight_id, pass, p, list_transform(p[k // 5 + 2 : k // 5 + 2 + k % 5], lambda x: x.e) AS found FROM (
      SELECT flight_id, pass, p, list_filter(range(len(p) * 5), lambda k: k // 5 + 3 + k % 5 <= len(p)
        AND p[k // 5 + 3 + k % 5].t - p[k // 5 + 1].t BETWEEN 1e-9 AND 60 AND NOT {beyond("p[k // 5 + 1]", "p[k // 5 + 3 + k % 5]")}
        AND list_bool_and(list_transform(p[k // 5 + 2 : k // 5 + 2 + k % 5], lambda x: {beyond("p[k // 5 + 1]", "x")} AND {beyond("x", "p[k // 5 + 3 + k % 5]")})))[1] AS k
      FROM step WHERE pass < 10
    ) WHERE k IS NOT NULL
  )
), spikes AS (SELECT flight_id, unnest(burst) AS event_id FROM step),
marked AS (
  SELECT ruled.* REPLACE (CASE WHEN spikes.event_id IS NOT NULL THEN 'short_position_spike' ELSE removal_reason END AS removal_reason)
  FROM ruled LEFT JOIN spikes ON spikes.flight_id = ruled.flight_id AND spikes.event_id = ruled.event_id
)"""

_QC = f"""{LEGS}, clean AS (
  SELECT flight_id, count(*) AS clean_points, coalesce(max(gap_sec), CAST('inf' AS DOUBLE)) AS max_gap_sec, median(gap_sec) AS median_gap_sec,
    (max(lastposupdate) - min(lastposupdate)) / 60 AS observed_duration_min,
    {haversine("arg_min(lat, lastposupdate)", "arg_min(lon, lastposupdate)", d(51.4706), d(-0.4619))} AS start_distance_km,
    {haversine("arg_max(lat, lastposupdate)", "arg_max(lon, lastposupdate)", d(50.038), d(8.5622))} AS end_distance_km,
    count(*) FILTER (WHERE step_km > {d(0.45)} * gap_sec + 2) AS unresolved_jump_segments FROM legs GROUP BY flight_id
), raw AS (SELECT flight_id, count(*) AS raw_points FROM positions GROUP BY flight_id),
qc AS (
  SELECT flight_id, raw_points, coalesce(clean_points, 0) AS clean_points, raw_points - coalesce(clean_points, 0) AS removed_points, max_gap_sec, median_gap_sec,
    observed_duration_min, start_distance_km, end_distance_km, unresolved_jump_segments,
    concat_ws(';', CASE WHEN clean_points < 60 THEN 'too_few_points' END, CASE WHEN max_gap_sec > 60 THEN 'gap_over_limit' END,
      CASE WHEN start_distance_km > 15 OR end_distance_km > 15 THEN 'endpoint_outside_15km' END,
      CASE WHEN unresolved_jump_segments > 0 THEN 'unresolved_position_jump' END, CASE WHEN clean_points IS NULL THEN 'no_valid_points' END) AS review_reason
  FROM raw LEFT JOIN clean USING (flight_id)
)"""
QC, QC_SCREENED = f"{MARKED}, {_QC}", f"{SCREENED}, {_QC}"

#: Valid points as sets: flight_id, t, lat, lon, idx, x, y, z.
SETS = f"""{MARKED},
u AS (
  SELECT flight_id, lastposupdate AS t, lat, lon, row_number() OVER (PARTITION BY flight_id ORDER BY lastposupdate, lat, lon) - 1 AS idx,
    cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM marked WHERE removal_reason = ''
)"""

C2 = "(p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)"

#: Distances of all pairs of sets: matrix (a, b, directed_a_to_b_km, directed_b_to_a_km, hausdorff_km).
MATRIX = f"""{SETS},
near AS (SELECT p.flight_id AS a, q.flight_id AS b, p.idx, min({C2}) AS c2 FROM u p JOIN u q ON p.flight_id <> q.flight_id GROUP BY ALL),
directed AS (SELECT a, b, max(c2) AS c2 FROM near GROUP BY a, b),
matrix AS (
  SELECT p.a, p.b, {arc("p.c2")} AS directed_a_to_b_km, {arc("q.c2")} AS directed_b_to_a_km, {arc("greatest(p.c2, q.c2)")} AS hausdorff_km
  FROM directed p JOIN directed q ON p.a = q.b AND p.b = q.a WHERE p.a < p.b
)"""

#: Both directions of the matrix, and the given clustering by lanes.
LANES = f"""{MATRIX},
sym AS (SELECT a AS i, b AS j, hausdorff_km AS d FROM matrix UNION ALL SELECT b, a, hausdorff_km FROM matrix),
ids AS (SELECT DISTINCT flight_id AS i FROM u),
labels AS (SELECT i, CASE WHEN i % 7 = 3 THEN -1 ELSE i % 5 END AS label FROM ids),
within AS (
  SELECT sym.i, j, d, p.label FROM sym JOIN labels p ON p.i = sym.i JOIN labels q ON q.i = sym.j AND q.label = p.label WHERE p.label >= 0
  UNION ALL SELECT i, i, {d(0)}, label FROM labels WHERE label >= 0
), totals AS (SELECT label, i, round(sum(d), 9) AS total, count(*) AS n FROM within GROUP BY label, i),
medoids AS (SELECT label, i AS medoid, n AS flights FROM totals QUALIFY row_number() OVER (PARTITION BY label ORDER BY total, i) = 1)"""
