import hashlib
import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.operators import arrivals, clean, cluster, hausdorff, lineage, sampling
from wayline.operators import cluster as cluster_module
from wayline.operators.common import ranked
from wayline.operators.grid import colour_limit
from wayline.operators.spikes import find_spikes, reject_spikes
from wayline.sources import sinks, tables
from wayline.streaming import positions as streams


def km(a, b):
    return float(haversine(np.array([a]), np.array([b]))[0, 0])


def plain_spikes(track, passes=10):
    """The rule in plain loops over (id, t, lat, lon)."""
    left, marked = list(track), set()
    far = lambda p, q: km(p[2:], q[2:]) > 0.45 * (q[1] - p[1]) + 2
    for _ in range(passes):
        found = None
        for i, size in itertools.product(range(len(left)), range(1, 6)):
            right = i + size + 1
            if right < len(left) and 0 < left[right][1] - left[i][1] <= 60 and not far(left[i], left[right]):
                if all(far(left[i], p) and far(p, left[right]) for p in left[i + 1 : right]):
                    found = left[i + 1 : right]
                    break
        if not found:
            break
        marked |= {p[0] for p in found}
        left = [p for p in left if p not in found]
    return marked


def straight(n, step=5.0, bursts=()):
    """A track to the north; the points of ``bursts`` (place, number) lie far to the south."""
    out = []
    for k in range(n):
        off = next((j for j, (at, size) in enumerate(bursts) if at <= k < at + size), None)
        out.append((k, k * step, 40 + k * 0.004 if off is None else -30.0 - off, 7.0 + 0.001 * k))
    return out


def test_spikes_against_plain_loops(spark):
    rng = np.random.default_rng(8)
    tracks = {
        1: straight(12, bursts=[(4, 1)]), 2: straight(12, bursts=[(3, 2), (7, 3)]), 3: straight(20, bursts=[(5, 5)]), 4: straight(20, bursts=[(5, 6)]),
        5: straight(12, step=31.0, bursts=[(4, 1)]), 6: straight(12, bursts=[(0, 1), (11, 1)]), 7: straight(60, bursts=[(4 * k + 2, 1) for k in range(13)]), 8: straight(9), 9: straight(1), 10: straight(12, step=30.0, bursts=[(4, 1)]),
    }
    for f in range(20, 32):
        t, track = 0.0, []
        for k in range(40):
            t += float(rng.choice([1, 5, 12, 25]))
            where = (-60.0 + k, 100.0) if rng.random() < 0.25 else (45 + 0.003 * k, 3.0)
            track.append((k, t, where[0] + 0.5 * rng.random() * (rng.random() < 0.2), where[1]))
        tracks[f] = track
    rows = [(f, k, t, t, lat, lon) for f, track in tracks.items() for k, t, lat, lon in track]
    df = spark.createDataFrame(rows, "flight_id long, event_id long, lastposupdate double, state_time double, lat double, lon double").repartition(3)
    got = {f: set() for f in tracks}
    for r in find_spikes(df).collect():
        got[r["flight_id"]].add(r["event_id"])
    assert got == {f: plain_spikes(track) for f, track in tracks.items()}
    assert len(got[3]) == 5 and not got[4] and not got[5] and not got[6] and len(got[7]) == 10 and len(got[10]) == 1
    assert find_spikes(df.limit(0)).count() == 0


def test_reject_spikes_marks_only_valid_rows(spark):
    rows = [(1, i, float(7 * i), float(7 * i), -33.0 if i == 3 else 12.5, 80.0 if i == 3 else 0.002 * i, "x" if i == 5 else "") for i in range(8)]
    df = spark.createDataFrame(rows, "flight_id long, event_id long, lastposupdate double, state_time double, lat double, lon double, removal_reason string")
    got = {r["event_id"]: r["removal_reason"] for r in reject_spikes(df).collect()}
    assert got == {i: "short_position_spike" if i == 3 else "x" if i == 5 else "" for i in range(8)}


def haversine(a, b):
    p, q = np.radians(a)[:, None, :], np.radians(b)[None, :, :]
    h = np.sin((q[..., 0] - p[..., 0]) / 2) ** 2 + np.cos(p[..., 0]) * np.cos(q[..., 0]) * np.sin((q[..., 1] - p[..., 1]) / 2) ** 2
    return 2 * 6371.0088 * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def test_hausdorff_against_dense_haversine(spark):
    rng = np.random.default_rng(4)
    near = lambda n, low, high: rng.uniform(low, high, (n, 2)).tolist()
    sets = {"few": near(6, [-5, 170], [5, 180]), "line": near(7, [-6, -180], [4, -171]), "pole": near(5, [85, -180], [90, 180]), "one": [[0, 0]]}
    sets |= {"long": near(1500, [40, 0], [50, 10]), "longer": near(1300, [41, 0], [50, 11])}
    sets["twin"] = sets["few"]
    rows = [(k, *map(float, p)) for k, v in sets.items() for p in v] + [("few", None, 1.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "flight_id string, lat double, lon double").repartition(3)
    want = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        d = haversine(np.array(sets[a], float), np.array(sets[b], float))
        want[a, b] = pytest.approx(d.min(axis=1).max(), abs=1e-7), pytest.approx(d.min(axis=0).max(), abs=1e-7)
    for block in (100_000, 500):
        got = {(r["a"], r["b"]): tuple(r)[2:] for r in hausdorff.distance_matrix(df, block_points=block).collect()}
        assert {k: v[:2] for k, v in got.items()} == want and all(h == max(ab, ba) for ab, ba, h in got.values())
    assert got["few", "twin"][2] == 0
    pairs = [(a, b, k) for k, (a, b) in enumerate([("few", "line"), ("long", "longer"), ("one", "pole"), ("few", "twin")])]
    side = lambda n: spark.createDataFrame(pairs, "a string, b string, k int").select(F.col(n).alias("flight_id"), "k").join(df.dropna(), "flight_id")
    for block in (100_000, 300):
        dense = {r["k"]: tuple(r)[1:] for r in hausdorff.dense_hausdorff(side("a").drop("flight_id"), side("b").drop("flight_id").unionByName(spark.createDataFrame([(9, 1.0, 1.0)], "k int, lat double, lon double")), ["k"], block_points=block).collect()}
        assert sorted(dense) == [0, 1, 2, 3] and all(dense[k] == pytest.approx(got[a, b], abs=1e-9) for a, b, k in pairs)


def test_witnesses_statistics_and_ranks(spark):
    rng = np.random.default_rng(6)
    sets = {k: rng.uniform([30, 10], [33, 14], (n, 2)) for k, n in ((1, 40), (2, 55), (3, 1))}
    rows = [(k, float(10 * i), *map(float, p)) for k, v in sets.items() for i, p in enumerate(v)]
    points = spark.createDataFrame(rows, "flight_id long, t double, lat double, lon double").repartition(4)
    pairs = spark.createDataFrame([(1, 2), (3, 1), (2, 2)], "a long, b long")
    for r in hausdorff.witnesses(pairs, points).collect():
        d = haversine(sets[r["flight_a"]], sets[r["flight_b"]])
        forward = d.min(axis=1).max() >= d.min(axis=0).max() - 1e-9
        near = d if forward else d.T
        s = int(near.min(axis=1).argmax())
        assert r["direction"] == ("a_to_b" if forward else "b_to_a") and (r["source_index"], r["source_t"]) == (s, 10.0 * s)
        assert r["target_index"] == int(near[s].argmin()) and r["hausdorff_km"] == pytest.approx(d.min(axis=1).max() if forward else d.min(axis=0).max(), abs=1e-7)
    values = np.round(rng.exponential(9, 1001), 1)
    matrix = spark.createDataFrame([(i, i + 1, float(v)) for i, v in enumerate(values)], "a long, b long, hausdorff_km double").repartition(7)
    r = hausdorff.pair_statistics(matrix).first()
    assert r["pairs"] == 1001 and [r[c] for c in ("min_km", "median_km", "p95_km", "max_km")] == pytest.approx([values.min(), np.median(values), np.percentile(values, 95), values.max()])
    assert tuple(hausdorff.pair_statistics(matrix.limit(0)).first()) == (0, 0.0, 0.0, 0.0, 0.0)
    places = ranked(matrix, F.desc("hausdorff_km"), "a").collect()
    assert [x["a"] for x in sorted(places, key=lambda x: x["rank"])] == sorted(range(1001), key=lambda i: (-values[i], i))


def plain_hdbscan(d, mcs, ms):
    """(labels, strengths) by cutting the longest edge of the spanning tree again and again; labels are sets of members."""
    n = len(d)
    core = np.sort(d, axis=1)[:, ms - 1]
    reach = np.maximum(d, np.maximum.outer(core, core))
    comp, tree = list(range(n)), []
    for w, i, j in sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        if comp[i] != comp[j]:
            tree.append((w, i, j))
            comp = [comp[i] if c == comp[j] else c for c in comp]
    clusters = []  # (parent, birth, [(point, level at which it leaves)], mass)

    def grow(members, edges, cluster):
        if not edges:
            return
        (w, i, j), rest = edges[-1], edges[:-1]
        side = {i}
        while (more := {p for e in rest for p in e[1:] if set(e[1:]) & side} - side):
            side |= more
        level = 1 / max(w, cluster_module.LEAST_KM)
        parts = [side, members - side]
        inner = [[e for e in rest if e[1] in part] for part in parts]
        if min(map(len, parts)) >= mcs:
            for part, held in zip(parts, inner):
                clusters[cluster][2] += [(p, level) for p in part]
                clusters.append([cluster, level, [], part])
                grow(part, held, len(clusters) - 1)
            return
        for part, held in zip(parts, inner):
            if len(part) >= mcs:
                grow(part, held, cluster)
            else:
                clusters[cluster][2] += [(p, level) for p in part]

    clusters.append([-1, 0.0, [], set(range(n))])
    grow(set(range(n)), tree, 0)
    mass = [sum(level - c[1] for _, level in c[2]) for c in clusters]

    def best(c):
        below = [best(k) for k in range(len(clusters)) if clusters[k][0] == c]
        inner = sum(v for v, _ in below)
        return (inner, [x for _, xs in below for x in xs]) if c == 0 or (below and inner > mass[c]) else (mass[c], [c])

    labels, strength = [-1] * n, [0.0] * n
    for c in best(0)[1]:
        inside = {c}
        while (more := {k for k in range(len(clusters)) if clusters[k][0] in inside} - inside):
            inside |= more
        last = {p: max(level for k in inside for q, level in clusters[k][2] if q == p) for p in clusters[c][3]}
        top = max(level for _, level in clusters[c][2])
        for p in clusters[c][3]:
            labels[p], strength[p] = c, min(last[p], top) / top
    return labels, strength


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hdbscan_against_plain_cuts(spark, seed):
    rng = np.random.default_rng(seed)
    n = 45
    centres = rng.uniform(0, 40, (4, 2))
    x = np.concatenate([centres[k] + rng.normal(0, 1.5, (10, 2)) for k in range(4)] + [rng.uniform(0, 40, (5, 2))])
    x[7] = x[3]  # a distance of 0
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 0 if seed == 3 else 1)  # many ties
    matrix = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(n) for j in range(i + 1, n)], "a long, b long, hausdorff_km double")
    settings = [(5, 3), (5, 5), (8, 3), (10, 1)]
    got = {(r["mcs"], r["ms"], r["i"]): (r["label"], r["strength"]) for r in cluster.hdbscan(matrix, settings).collect()}
    for mcs, ms in settings:
        labels, strength = plain_hdbscan(d, mcs, ms)
        mine = [got[mcs, ms, i] for i in range(n)]
        assert [[a == b for b, _ in mine] for a, _ in mine] == [[a == b for b in labels] for a in labels]
        assert [label == -1 for label, _ in mine] == [label == -1 for label in labels]
        assert [s for _, s in mine] == pytest.approx(strength)


def test_clustering(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (20, 2)), rng.normal(30, 1, (15, 2)), [[200, 200]]])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    matrix = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(36) for j in range(i + 1, 36)], "a long, b long, hausdorff_km double").repartition(3)
    core = {r["i"]: r["core"] for r in cluster.core_distances(matrix, [3]).collect()}
    assert all(core[i] == np.sort(d[i])[2] for i in range(36))
    reach = np.maximum(d, np.maximum.outer([core[i] for i in range(36)], [core[i] for i in range(36)]))
    inside, total = {0}, 0.0
    while len(inside) < 36:
        w, j = min((reach[i, j], j) for i in inside for j in range(36) if j not in inside)
        total += w
        inside.add(j)
    tree = cluster.spanning_edges(cluster.mutual_reachability(matrix, cluster.core_distances(matrix, [3]))).collect()
    assert len(tree) == 35 and sum(r["w"] for r in tree) == pytest.approx(total)
    out = cluster.hdbscan(matrix, [(5, 3), (10, 3), (30, 3)]).cache()
    label = {(r["mcs"], r["i"]): r["label"] for r in out.collect()}
    for size in (5, 10):
        assert len({label[size, i] for i in range(20)} - {-1}) == 1 and len({label[size, i] for i in range(20, 35)} - {-1}) == 1
        assert label[size, 35] == -1 and max(label[size, i] for i in range(20)) != max(label[size, i] for i in range(20, 35))
    assert all(label[30, i] == -1 for i in range(36))  # no split is real, and the root is never chosen
    assert {r["mcs"]: r["clusters"] for r in cluster.sweep(out).collect()} == {5: 2, 10: 2, 30: 0}
    assert all(0 <= r["strength"] <= 1 for r in out.collect())
    assert 35 in {r["i"] for r in cluster.persistent_noise(out).collect()}


def test_qc_edges(spark):
    flights = spark.createDataFrame([(1, "p", 0.0, 100.0), (2, "p", 0.0, 100.0)], "flight_id long, icao24 string, start_unix double, end_unix double")
    points = spark.createDataFrame([(1, 1, 51.4706, -0.4619, 10.0, 11.0, 11.0, "p"), (1, 2, None, 0.0, 20.0, 21.0, 21.0, "p"), (2, 3, 91.0, 0.0, 10.0, 11.0, None, None), (2, 4, 50.0, 0.0, 10.0, 11.0, None, "p"), (2, 5, 50.0, 0.0, 10.0, 11.0, 11.0, None)], "flight_id long, event_id long, lat double, lon double, lastposupdate double, state_time double, lastcontact double, icao24 string")
    marked = clean.reject_repeats(clean.reject_rows(points, flights))
    assert {r["event_id"]: r["removal_reason"] for r in marked.collect()} == {1: "", 2: "invalid_coordinate", 3: "invalid_coordinate", 4: "stale_or_invalid_contact_time", 5: "aircraft_mismatch"}
    qc = {r["flight_id"]: r for r in clean.flight_qc(marked, flights).collect()}
    assert qc[1]["max_gap_sec"] == float("inf") and qc[1]["median_gap_sec"] is None and qc[1]["review_reason"] == "too_few_points;gap_over_limit;endpoint_outside_15km"
    assert qc[2]["review_reason"] == "no_valid_points" and qc[2]["clean_points"] == 0 and qc[2]["removed_points"] == 3


def test_sampling_prefers_the_earlier_on_ties(spark):
    points = spark.createDataFrame([(1, t, 50.0, t / 1000) for t in (0.0, 5.0, 15.0, 31.0)] + [(2, 7.0, 0.0, 0.0)], "flight_id long, t double, lat double, lon double")
    got = [(r["flight_id"], r["k"], r["t"], r["offset_sec"]) for r in sampling.nearest_observations(points, 10).orderBy("flight_id", "k").collect()]
    assert got == [(1, 0, 0.0, 0.0), (1, 1, 5.0, 5.0), (1, 2, 15.0, 5.0), (1, 3, 31.0, 1.0), (2, 0, 7.0, 0.0)]
    assert [r["segment_id"] for r in arrivals.gap_segments(points.where("flight_id = 1"), 10.0).orderBy("t").collect()] == [0, 0, 0, 1]


def test_lineage(spark):
    ids = spark.createDataFrame([(0, "a"), (1, "b")], "matrix_index long, flight_id string")
    points = spark.createDataFrame([("a", 1.0), ("b", None)], "flight_id string, lat double")
    matrix = spark.createDataFrame([("a", "b", 2.0)], "a string, b string, hausdorff_km double")
    held = lineage.manifest(points, matrix, ids)
    swapped = spark.createDataFrame([(1, "a"), (0, "b")], "matrix_index long, flight_id string")
    assert lineage.is_current(held, points.repartition(3), matrix, ids, ids)
    assert not lineage.is_current(None, points, matrix, ids, ids)
    assert not lineage.is_current(held, points.withColumn("lat", F.lit(1.0)), matrix, ids, ids)
    assert not lineage.is_current(held, points, matrix.withColumn("hausdorff_km", F.lit(3.0)), ids, ids)
    assert not lineage.is_current(held, points, matrix, swapped, ids) and not lineage.is_current(held, points, matrix, ids, swapped)


def test_files(spark, tmp_path):
    plain = tmp_path / "p.csv"
    plain.write_text("flight_id,lat,extra\n" + "".join(f"f{i},{i}.5,x\n" for i in range(50)))
    schema = tables.POINTS
    got = tables.read_csv(spark, str(plain), schema, ["flight_id", "lat"])
    assert got.count() == 50 and got.columns == ["flight_id", "lat"]
    narrow = type(schema)([schema["flight_id"], schema["lat"]])
    assert {(r["flight_id"], r["source_csv_line"]) for r in tables.with_source_line(spark, str(plain), narrow).collect()} == {(f"f{i}", i + 2) for i in range(50)}
    sinks.write_csv(got, str(tmp_path / "out"), ["lat"], compress=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 50
    (tmp_path / "q.csv").write_text(tables.POINTER + "/v1\n")
    with pytest.raises(ValueError):
        tables.refuse_pointer(spark, str(tmp_path / "q.csv"))
    assert tables.file_digests(spark, str(plain)).count() == 1
    odd = spark.createDataFrame([("a", "2025-06-01T00:00:00Z", "1", "2"), ("a", "no", "1", "2"), ("b", "2025-06-01T00:00:00Z", "x", "2")], "flight_id string, time string, latitude string, longitude string")
    assert [tuple(r) for r in tables.normal_points(odd).collect()] == [("a", 1748736000.0, 1.0, 2.0)]


def test_streams(spark, tmp_path):
    flights = spark.createDataFrame([("f", "p", 0.0, 1e12)], "flight_id string, icao24 string, start_unix double, end_unix double")
    for part, times in enumerate([(0, 10, 10, 20, 500, 5000), (50_000,), (100_000,)]):
        rows = [("f", i, 50.0, 1.0, float(t), float(t) + 1, float(t) + 1, "p") for i, t in enumerate(times)]
        df = spark.createDataFrame(rows, "flight_id string, event_id long, lat double, lon double, lastposupdate double, state_time double, lastcontact double, icao24 string").withColumn("ts", F.timestamp_seconds("state_time"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)  # files are taken in the order of their times
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, out in (("kept", streams.valid_positions(stream, flights)), ("runs", streams.sessions(stream))):
        query = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert spark.table("kept").count() == 7
    runs = sorted((r["first"].timestamp(), r["points"]) for r in spark.table("runs").collect())
    assert runs[:3] == [(1.0, 4), (501.0, 1), (5001.0, 1)]


def test_gates(spark):
    of = lambda *keys: spark.createDataFrame([(k, f"v{k}") for k in keys], "k long, v string")
    assert clean.assert_unique(of(1, 2), "k").count() == 2
    assert sorted(map(tuple, clean.key_differences(of(1, 2, 2), of(2, 3), "k").collect())) == [(1, "left"), (3, "right")]
    clean.require_same_keys(of(1, 2), of(2, 1), "k")
    assert clean.exactly_one(of(1)).count() == 1
    joined = clean.validated_join(of(1, 2), of(2, 1, 3).withColumnRenamed("v", "w"), "k")
    assert sorted(map(tuple, joined.collect())) == [(1, "v1", "v1"), (2, "v2", "v2")]
    for bad in (lambda: clean.require_same_keys(of(1), of(1, 2), "k"), lambda: clean.require_same_keys(of(1, 1), of(1), "k"), lambda: clean.exactly_one(of()), lambda: clean.exactly_one(of(1, 2))):
        with pytest.raises(ValueError):
            bad()
    for left, right in ((of(1, 1), of(1)), (of(1), of(1, 1)), (of(1, 2), of(1))):
        with pytest.raises(Exception, match="repeats|without a row"):
            clean.validated_join(left, right.withColumnRenamed("v", "w"), "k").collect()
    assert cluster.settings_grid(12, (40, 2)) == [(5, 5), (5, 10), (10, 5), (10, 10), (40, 2)] and len(cluster.settings_grid(100)) == 15
    rows = [(1, 2, 3.0), (1, 3, float("nan")), (3, 2, -1.0), (1, 2, 3.0)]
    matrix = spark.createDataFrame([(a, b, d, d, d) for a, b, d in rows], "a long, b long, directed_a_to_b_km double, directed_b_to_a_km double, hausdorff_km double")
    with pytest.raises(ValueError, match="repeated_pairs"):
        hausdorff.require_sound(matrix, 3)
    assert hausdorff.require_sound(matrix.where("a = 1 AND b = 2").limit(1), 2).count() == 1


def test_matrices_as_files(spark, tmp_path):
    ids = ["b", "a", "c"]
    pairs = spark.createDataFrame([("b", "a", 1.5), ("b", "c", 2.0), ("a", "c", 0.25)], "i string, j string, d double")
    wide = sinks.wide_matrix(pairs, ids)
    sinks.write_csv(wide, str(tmp_path / "m"), ["i"], files=1)
    back = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "m"))
    assert sorted(map(tuple, sinks.long_matrix(back, ids).collect())) == sorted(map(tuple, pairs.collect()))
    broken = [wide.where("i <> 'a'"), wide.drop("a"), wide.withColumn("a", F.lit(9.0)), wide.withColumn("c", F.when(F.col("i") != "b", F.col("c"))), wide.unionByName(wide.where("i = 'a'")), wide.withColumn("b", -F.col("b") - 1)]
    for df in broken:
        with pytest.raises(ValueError):
            sinks.long_matrix(df, ids)
    report = spark.createDataFrame([(1, {"x": 2}, None)], "n long, sizes map<string,long>, gap double")
    sinks.write_json_report(report, str(tmp_path / "r"))
    got = tables.read_json_report(spark, str(tmp_path / "r")).first()
    assert got["n"] == 1 and got["sizes"]["x"] == 2
    sinks.write_text(spark.createDataFrame([(7,)], "n int"), "n", str(tmp_path / "t"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["7"]
    grid = spark.createDataFrame([(1.2,), (None,), (float("nan"),)], "value double")
    limit = lambda df, least: colour_limit(df, least, 1.0).first()["upper"]
    assert limit(grid, 2.0) == 2.0 and limit(grid, 0.5) == 2.0 and limit(grid.where("value IS NULL"), 3.0) == 3.0


def test_lines_digests_and_latest_files(spark, tmp_path):
    long = tmp_path / "long.csv"
    long.write_text("flight_id,lat\n" + "".join(f"f{i},{i}.5\n" for i in range(5000)))
    narrow = type(tables.POINTS)([tables.POINTS["flight_id"], tables.POINTS["lat"]])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = {(r["flight_id"], r["source_csv_line"]) for r in tables.with_source_line(spark, str(long), narrow).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert lines == {(f"f{i}", i + 2) for i in range(5000)}
    for whole in (10**9, 0):
        (found,) = tables.file_digests(spark, str(long), whole_bytes=whole).collect()
        assert found["sha256"] == hashlib.sha256(long.read_bytes()).hexdigest()
    for name, lat in (("flight_A_1.csv", 1), ("flight_A_2.csv", 2), ("flight_B_1.csv", 3), ("other.csv", 4)):
        (tmp_path / name).write_text(f"lat,flight_id\n{lat},x\n")
    got = tables.latest_rows(spark, str(tmp_path / "*.csv"), r"^flight_([A-Z])_\d+\.csv$", narrow, ["flight_id", "lat"])
    assert sorted(map(tuple, got.collect())) == [("A", "flight_A_2.csv", "x", 2.0), ("B", "flight_B_1.csv", "x", 3.0)]
    assert tables.latest_rows(spark, str(tmp_path / "*.csv"), "^none_(.)$", narrow, ["lat"]).collect() == []
    ids = spark.createDataFrame([("f3",), ("f3",), ("none",)], "flight_id string")
    assert tables.rows_of(tables.read_csv(spark, str(long), narrow), ids).count() == 1


def test_strict_times(spark):
    df = spark.createDataFrame([("2025-06-01T00:00:00Z",), (None,)], "time string")
    assert sorted((r[0] for r in df.select(tables.strict_seconds(df, "time")).collect()), key=str) == [1748736000.0, None]
    bad = df.unionByName(spark.createDataFrame([("soon",)], "time string"))
    with pytest.raises(Exception, match="is not a time"):
        bad.select(tables.strict_seconds(bad, "time")).collect()
    seconds = spark.createDataFrame([(0, 1748736000.0), (1, 1748736000.25), (2, -1.0), (3, None)], "k int, s double")
    assert [r[0] for r in seconds.orderBy("k").select(tables.utc_text(F.col("s"))).collect()] == ["2025-06-01 00:00:00+00:00", "2025-06-01 00:00:00.250000+00:00", "1969-12-31 23:59:59+00:00", None]
