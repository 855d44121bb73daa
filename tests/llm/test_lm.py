import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm.lm import op4_lm_score, score_texts
from wayline.llm.words import pack_keys, unpack_keys


def brute(rows, prior, order, min_context):
    cut = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), ("end",)]
    counts, n, types = Counter(), 0, set()
    for _, t, train in rows:
        if train:
            words = [("begin",), *cut(t)]
            n += len(words) - 1
            types |= set(words[1:])
            counts.update(tuple(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1))
    known = lambda h: counts[h] >= (min_context if len(h) > 1 else 1)

    def p(word, h):
        if not h:
            return (counts[(word,)] + 0.5) / (n + 0.5 * (len(types) + 1))
        return (counts[(*h, word)] + prior * p(word, h[1:])) / (counts[h] + prior) if known(h) else p(word, h[1:])

    out = []
    for i, t, _ in rows:
        words = [("begin",), *cut(t)]
        base = sum(math.log10(p(w, ())) for w in words[1:])
        score = sum(math.log10(p(words[k], tuple(words[max(0, k - order + 1) : k]))) for k in range(1, len(words)))
        out.append((i, len(words) - 1, sum(counts[(w,)] > 0 for w in words[1:]), n, base, score))
    return out


@pytest.mark.parametrize("order,min_context,sizes", [(3, 2, {}), (3, 4, {"chunk_chars": 300, "shard_keys": 40}), (2, 8, {"chunk_chars": 300, "shard_keys": 40}), (4, 1, {"chunk_chars": 500}), (5, 1, {"chunk_chars": 900, "shard_keys": 60}), (5, 3, {"shard_keys": 60})])
def test_against_brute_force(spark, order, min_context, sizes):
    rng = random.Random(5)
    vocabulary = ["The", "the", "a", "é", "cat", "sat", "on", "mat."]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 20]))), i % 5 != 1) for i in range(120)]
    rows += [(500, None, True), (500, None, False), (501, "", True), (None, "unseen words the", False), (502, "the cat\n" * 900, True), (503, "Zoë zoë", None), (504, "unseen words the cat " * 300, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Train boolean").withColumn("chunk", F.lit("clash")).repartition(3)
    got = score_texts(docs, F.col("Train"), prior=3.0, order=order, min_context=min_context, **sizes).collect()
    key = lambda r: (str(r[0]), *r[1:])
    got, want = sorted(map(tuple, got), key=key), sorted(brute(rows, 3.0, order, min_context), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4:] == pytest.approx(w[4:], rel=1e-9)


def test_many_copies_of_one_row_spread_over_chunks(spark):
    rows = [(None, "the cat sat on the mat", True)] * 10_000 + [(1, "the cat sat", False), (2, "a dog", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(1).sortWithinPartitions("doc_id")
    scored = score_texts(docs, F.col("train"), chunk_chars=2_000, prior=3.0)
    got = {tuple(r) for r in scored.distinct().collect()}
    assert scored.count() == len(rows) and len(got) == 3
    want = {w[0]: w for w in brute(rows[9_999:], 3.0, 3, 1)}
    counts = Counter(r[0] for r in scored.select("doc_id").collect())
    assert counts[None] == 10_000 and {g[:3] for g in got} == {w[:3] for w in want.values()}
    whole = {w[0]: w for w in brute([rows[0]] * 10_000 + rows[-2:], 3.0, 3, 1)}
    for g in got:
        assert g[3:] == pytest.approx(whole[g[0]][3:], rel=1e-9)
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(110))
    assert docs.groupBy(chunk).count().agg(F.max("count")).first()[0] < 200


def test_score_beats_the_base_on_held_out_texts(spark):
    out = op4_lm_score(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    better = (out.score - out.base_score) / out.n_tokens
    assert len(out) > 100 and (better > 0).mean() > 0.7 and better.mean() > 0.1


def test_packed_keys():
    rng = np.random.default_rng(3)
    for n, low, high in ((0, 0, 1), (1, 5, 6), (1, 2**63, 2**63 + 1), (50_000, 0, 2**64 - 1), (40_000, 2**60, 2**60 + 2**55), (300, 0, 1000), (9, 0, 2**64 - 1)):
        keys = np.unique(rng.integers(low, high, n, dtype=np.uint64, endpoint=False))
        packed = pack_keys(keys)
        assert (unpack_keys(*packed) == keys).all() and (n < 40_000 or sum(map(len, packed)) < 7 * len(keys))


def test_no_training_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = score_texts(docs, F.lit(False)).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in out] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert score_texts(docs.limit(0), F.lit(True)).count() == 0
