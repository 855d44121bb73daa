import random

import corpus_pipeline as pipeline
from wayline.llm.common import read
from wayline.llm.quality import fit_quality, learning_labels, score_quality

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_near(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(i for i in ids if find(i) == i)


def test_stages_one_after_another(spark):
    docs = read(spark, SF, "documents")
    scored = score_quality(docs, fit_quality(docs, learning_labels(spark, SF)))
    want = {r["doc_id"] for r in scored.where("score >= 0.3").select("doc_id").collect()}
    kept = pipeline.quality(spark, docs, SF).cache()
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want and len(want) > 100

    texts = {}
    for r in kept.collect():
        texts.setdefault(r["text"] or "", []).append(r["doc_id"])
    unique = pipeline.exact_copies(spark, kept, SF).cache()
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(min(v) for v in texts.values())

    near = pipeline.near_copies(spark, unique, SF).cache()
    assert sorted(r["doc_id"] for r in near.collect()) == brute_near([(r["doc_id"], r["text"]) for r in unique.collect()])

    out = pipeline.packed(spark, near, SF)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in near.collect())
    ran = pipeline.run(spark, SF)
    assert sorted(map(tuple, ran.collect())) == sorted(map(tuple, out.collect()))


def test_odd_rows(spark):
    rng = random.Random(2)
    prose = " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps"], k=60))
    rows = [(1, prose, "en", "a", 5, "k"), (1, prose, "en", "a", 5, "k"), (2, prose, None, "a", 5, "k"), (None, prose, "en", None, 5, "k"), (3, None, "en", "a", None, "k"), (4, "", "en", "a", 0, None), (5, prose + " end", "en", "a", 0, None), (6, "x " * 30_000, "en", "a", 0, None)]
    docs = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in COLUMNS) + ", Kept string").withColumnRenamed("nothing", "x")
    unique = pipeline.exact_copies(spark, docs, SF)
    assert unique.columns == [*COLUMNS, "Kept"]
    assert sorted(r["doc_id"] for r in unique.collect()) == [1, 1, 3, 5, 6]
    near = pipeline.near_copies(spark, docs, SF)
    assert sorted((r["doc_id"] or 0) for r in near.collect()) == [0, 1, 1, 3, 4, 6]
    assert pipeline.quality(spark, docs, SF).columns == docs.columns
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
