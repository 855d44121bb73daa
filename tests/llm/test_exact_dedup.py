import pytest
from pyspark.sql import functions as F

from wayline.llm import exact_dedup as module
from wayline.llm.exact_dedup import exact_dedup, op9_exact_dedup

ROWS = [(5, "a", 1), (2, "a", 2), (9, "a", 3), (3, None, 4), (4, "", 5), (7, "b" * 90_000, 6), (None, "c", 7), (8, "c", 8), (None, "d", 9), (None, "d", 9), (6, " a", 1), (1, "e", 1), (1, "e", 1)]


def brute(keep):
    best, groups = (min if keep == "smallest" else max), {}
    for i, t, x in ROWS:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, x in ROWS:
        ids = [g for g in groups[t or ""] if g is not None]
        k = best(ids) if ids else None
        out.append((i, x, k, len(groups[t or ""]), i == k))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("bits", ["md5", "one", "two"])
def test_against_brute_force_also_under_collisions(spark, keep, bits):
    hash_of = {"one": lambda t: F.lit(b"x"), "two": lambda t: F.substring(F.unhex(F.md5(t)), 1, 1) > F.lit(b"\x7f")}.get(bits)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, Kept int").repartition(3)
    out = exact_dedup(docs.withColumnRenamed("Kept", "x"), keep=keep, **({"hash_of": hash_of} if hash_of else {}))
    assert sorted(map(tuple, out.select("doc_id", "x", "keep_id", "group_size", "kept").collect()), key=str) == brute(keep)


def test_clashing_names_and_empty(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, Kept int")
    assert exact_dedup(docs).columns == ["doc_id", "text", "keep_id", "group_size", "kept"]
    assert exact_dedup(docs.limit(0)).count() == 0


def test_the_query_joins_without_texts(spark, monkeypatch):
    """Also where there are too many groups to broadcast."""
    monkeypatch.setattr(module, "broadcast_if_small", lambda df, rows: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = op9_exact_dedup(spark, "/root/testdata/sf0.001")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("Join") :].split("Relation")[0]
        carried = [line for line in below.split("\n") if "Project" in line]
        assert "Join" in plan and not any("#" in c and c.strip().startswith(("text#", "__text#")) for line in carried for c in line.split("[")[1].split("]")[0].split(", "))
        rows = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.undo()
    assert rows == sorted(map(tuple, op9_exact_dedup(spark, "/root/testdata/sf0.001").collect()))
