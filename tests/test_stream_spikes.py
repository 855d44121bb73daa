"""Spikes on streams equal those of the batch rule, however the rows fall into batches."""

import random

import pytest

from wayline.operators.spikes import find_spikes
from wayline.streaming.spikes import mark_spikes, settle

SCHEMA = "flight_id long, lastposupdate double, state_time double, event_id long, lat double, lon double"


def tracks(rng, flights, points):
    """Straight flights with jumps of one to seven points, some of them side by side, and repeated times."""
    rows, event = [], 0
    for f in range(flights):
        t, off, left = 1000.0 * f, 0.0, 0
        for k in range(points):
            t += rng.choice([0.0, 3.0, 5.0, 9.0, 9.0, 30.0])
            if left == 0:
                off = rng.choice([0.0, 0.0, 0.0, 0.0, 0.3, -0.4, 0.8])
                left = rng.choice([1, 1, 2, 3, 5, 7]) if off else 1
            left -= 1
            rows.append((f, t, t + rng.choice([0.0, 1.0]), event, 50.0 + 0.0004 * t % 1 + off, 8.0 + 0.0005 * k))
            event += 1
    return rows


def test_settled_in_any_steps_equals_the_batch_rule(spark):
    rng = random.Random(4)
    rows = tracks(rng, 30, 60)
    want = {tuple(r) for r in find_spikes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(want) > 60
    got = set()
    for f in range(30):
        mine = sorted(r[1:] for r in rows if r[0] == f)
        held, bursts, until, final = [], 0, mine[0][0], 0
        while mine or held:
            until += rng.choice([1.0, 20.0, 200.0])
            while mine and mine[0][0] <= until:
                held.append(mine.pop(0))
            gone, bursts = settle(held, bursts, until)
            got |= {(f, p[2]) for p in gone}
            held = [p for p in held if p[0] + 120 > until]
    assert got == want


def test_stream_equals_the_batch_rule(spark, tmp_path):
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(9)
    rows = tracks(rng, 4, 40)
    want = {tuple(r) for r in find_spikes(spark.createDataFrame(rows, SCHEMA)).collect()}
    late = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 100))  # out of order, within the delay
    cuts = sorted({0, len(late), *rng.sample(range(1, len(late)), 3)})
    batches = [late[a:b] for a, b in zip(cuts, cuts[1:])] + [[(99, 1e6, 1e6, -1, 0.0, 0.0)]]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "part=*"))
    query = mark_spikes(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(240)
    assert query.exception() is None
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["event_id"] for r in out) == sorted(r[3] for r in rows)
    assert {(r["flight_id"], r["event_id"]) for r in out if r["spike"]} == want and want
