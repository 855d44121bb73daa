import itertools
import math
import random
from collections import defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayline.llm.bpe import bpe_encode, public_vocabulary
from wayline.llm.common import read
from wayline.llm.packing import BUCKETS, TOKEN_BUDGET, op5_packing, optimal_boundaries, pack, pack_documents, token_batches

SF = "/root/testdata/sf0.001"


def padding(pairs, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in pairs)


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(150):
        pairs = [(n, rng.randint(1, 9)) for n in rng.sample(range(40), rng.randint(1, 9))]
        for k in (1, 2, 3, 5, 20):
            bounds = optimal_boundaries(pairs, k)
            top = max(n for n, _ in pairs)
            best = min(padding(pairs, (*cut, top)) for r in range(min(k, len(pairs))) for cut in itertools.combinations(sorted(n for n, _ in pairs), r))
            assert len(bounds) <= k and padding(pairs, bounds) == best
    assert optimal_boundaries([], 4) == []


def test_pack_fills_batches(spark):
    rows = [(i, "w " * (i % 37)) for i in range(900)] + [(5, "w " * 5), (None, None), (1000, "w " * 5000), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    slim = docs.withColumn("n", F.size(F.filter(F.split("text", " "), lambda w: w != ""))).withColumn("Batch", F.lit("clash"))
    out = pack(slim, F.when(F.col("n") > 0, F.col("n")), ["doc_id", "n"], buckets=4, token_budget=100).collect()
    check(rows, out, 4, 100)


def check(rows, out, buckets, budget):
    assert len(out) == len(rows)
    batches = defaultdict(list)
    for r in out:
        assert 0 <= r["padding"] == r["bucket_length"] - r["n_tokens"] or r["bucket_length"] == 1
        batches[r["bucket"], r["batch"]].append(r)
    last = {}
    for (b, k), rs in batches.items():
        room = max(1, budget // rs[0]["bucket_length"])
        assert sorted(r["slot"] for r in rs) == list(range(len(rs))) and len(rs) <= room
        last[b] = max(last.get(b, 0), k)
    for (b, k), rs in batches.items():
        assert k == last[b] or len(rs) == max(1, budget // rs[0]["bucket_length"])
    lengths = defaultdict(int)
    for r in out:
        lengths[r["n_tokens"]] += 1
    assert sorted({r["bucket_length"] for r in out}) == [max(1, b) for b in optimal_boundaries(list(lengths.items()), buckets)]


def plain_pack(rows, buckets, budget):
    """(id, length, bucket, bound, batch, slot, padding) by the plain programme over all boundaries, in the order of id."""
    lengths = sorted({n for _, n in rows})
    count = [sum(n == m for _, n in rows) for m in lengths]
    waste = lambda i, j: sum((lengths[j] - lengths[k]) * count[k] for k in range(i, j + 1))
    best = {0: [(0 if j < 0 else math.inf, []) for j in range(-1, len(lengths))]}
    for k in range(1, buckets + 1):
        best[k] = [(0, [])] + [min((best[k - 1][i][0] + waste(i, j), [*best[k - 1][i][1], lengths[j]]) for i in range(j + 1)) for j in range(len(lengths))]
    bounds = min((best[k][-1] for k in range(1, buckets + 1)), key=lambda x: x[0])
    return bounds


def test_query_against_a_plain_version(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = [(r["doc_id"], r["text"] or "") for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    rows = [(i, len(e.ids)) for (i, _), e in zip(docs, library.encode_batch([t for _, t in docs], add_special_tokens=False))]
    out = op5_packing(spark, SF).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out) == sorted(rows)
    check(rows, out, BUCKETS, TOKEN_BUDGET)
    assert sum(r["padding"] for r in out) == plain_pack(rows, BUCKETS, TOKEN_BUDGET)[0]
    for b in {r["bucket"] for r in out}:
        mine = sorted((r for r in out if r["bucket"] == b), key=lambda r: (r["batch"], r["slot"]))
        assert [r["doc_id"] for r in mine] == sorted(r["doc_id"] for r in mine)


def test_batches_of_ids(spark):
    vocabulary = public_vocabulary()
    docs = spark.createDataFrame([(i, "word " * (i % 23), "x") for i in range(200)] + [(900, None, "y"), (901, "w " * 700, None)], "doc_id long, text string, source string").repartition(3)
    ids = bpe_encode(docs, vocabulary).drop("text")
    out = token_batches(pack(ids, F.size("ids"), ["doc_id"], buckets=3, token_budget=120), pad_id=-1).collect()
    want = {r["doc_id"]: r["ids"] for r in ids.collect()}
    seen = []
    for batch in out:
        assert len(batch["padded"]) * batch["bucket_length"] <= 120 or len(batch["padded"]) == 1
        for row, padded in zip(batch["rows"], batch["padded"]):
            assert len(padded) == batch["bucket_length"] and padded[: row["n_ids"]] == want[row["doc_id"]] and set(padded[row["n_ids"] :]) <= {-1}
            seen.append(row["doc_id"])
    assert sorted(seen) == sorted(want) and token_batches(pack(ids.limit(0), F.size("ids"), ["doc_id"])).count() == 0


def test_many_lengths_and_empty(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), F.col("id").cast("int")).alias("text"))
    out = pack(docs, F.col("doc_id"), ["doc_id"], buckets=3).collect()
    assert len(out) == 500 and all(r["n_tokens"] <= r["bucket_length"] for r in out)
    assert pack_documents(docs.limit(0)).columns == pack_documents(docs).columns
    assert pack_documents(docs.limit(0)).count() == 0
    assert sorted(r["n_tokens"] for r in pack_documents(spark.createDataFrame([(None, None), (None, None), (1, " ")], "doc_id long, text string")).collect()) == [0, 0, 1]


def test_many_equal_rows_take_a_slot_each(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(5).alias("n")).repartition(6)
    out = pack(docs, F.col("n"), ["doc_id"], token_budget=50).collect()
    assert sorted((r["batch"], r["slot"]) for r in out) == [(k // 10, k % 10) for k in range(3000)]


def test_bounds_are_exact_for_any_number_of_lengths(spark):
    lengths = [*range(1, 17_001), 16_000_000]
    docs = spark.range(1, 17_002).select(F.when(F.col("id") > 17_000, 16_000_000).otherwise(F.col("id")).alias("n"))
    best = min(range(1, 17_001), key=lambda cut: cut * cut + (17_000 - cut) * 17_000)  # three buckets: up to cut, up to 17,000, the long one
    out = pack(docs, F.col("n"), ["n"], buckets=3).agg(F.collect_set("bucket_length").alias("bounds"), F.sum("padding").alias("padding")).first()
    assert sorted(out["bounds"]) == [best, 17_000, 16_000_000]
    assert out["padding"] == padding([(n, 1) for n in lengths], out["bounds"])


def test_bounds_of_fifty_thousand_lengths():
    pairs = [(n, 1) for n in range(1, 50_001)]
    bounds = optimal_boundaries(pairs, 2)
    best = min(range(1, 50_001), key=lambda cut: cut * (cut - 1) // 2 + (50_000 - cut) * (49_999 - cut) // 2)
    assert bounds == [best, 50_000]
