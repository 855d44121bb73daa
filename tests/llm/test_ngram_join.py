import itertools
import random

import numpy as np
import pytest

from wayline.llm.ngram_join import Bands, jaccard_classes, shingle_sets, signatures


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if None not in (rows[i][0], rows[j][0]) and (same_id or a and b and 100 * len(a & b) >= 75 * len(a | b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    out = []
    for i, (doc_id, *_) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if find(k) == find(i) and rows[k][0] is not None]
        out.append((doc_id, len(sets[i]), doc_id if not sets[i] or doc_id is None else min(ids)))
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    sources = [rng.choices(words, k=rng.choice([1, 3, 4, 5, 6, 9, 20, 45, 120, 400])) for _ in range(n // 6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(sources))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            at = rng.randrange(len(w))
            edit = rng.choice(["swap", "cut", "add"])
            if edit == "swap":
                w[at] = rng.choice(words)
            elif edit == "cut" and len(w) > 1:
                del w[at : at + rng.choice([1, len(w) // 10 + 1])]
            else:
                w[at:at] = rng.choices(words, k=rng.choice([1, len(w) // 8 + 1]))
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w) if w else ""))
    return rows


@pytest.mark.parametrize("seed,sizes", [(1, {}), (2, {"bucket": 2, "crowd_rows": 5}), (3, {"bucket": 3, "shard_entries": 50, "crowd_rows": 1000}), (4, {"bucket": 1, "crowd_rows": 3}), (5, {"parts": 4, "lose": 2, "bucket": 4}), (6, {"parts": 5, "lose": 1}), (7, {"parts": 2, "lose": 1, "bucket": 3}), (8, {"node_bits": 6}), (9, {"node_bits": 5, "bucket": 2, "crowd_rows": 5})])
def test_against_brute_force(spark, seed, sizes):
    rows = corpus(seed, 260)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, rows[0][1]), (None, None), rows[5], rows[5], (1003, rows[7][1]), (1004, "A b C d E"), (1005, "a B c D e"), (1006, "a b c d")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, Node string").repartition(5)
    got = [tuple(r) for r in jaccard_classes(docs, **sizes).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == brute(rows)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(90)] = f"e{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard_classes(docs, bucket=16, crowd_rows=64).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(rows))


@pytest.mark.parametrize("shape", [(3, 1), (4, 2), (5, 2), (4, 1), (2, 1)])
def test_similar_sets_share_their_slack(shape):
    rng = np.random.default_rng(5)
    bands = Bands(75, 2000, *shape)
    least = []
    for n in (3, 12, 33, 90, 400, 1500):
        base = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for drop in {0, n // 20, n // 9, n // 5}:
            # the worst differences: the features left out are spread over the partitions
            spread = np.sort(rng.permutation(n)[:drop]) if rng.random() < 0.5 else np.linspace(0, n - 1, drop).astype(int)
            other = np.unique(np.concatenate([np.delete(base, spread), rng.integers(0, 2**64, drop // 4, dtype=np.uint64)]))
            union = len(np.union1d(base, other))
            if 100 * len(np.intersect1d(base, other)) < 75 * union:
                continue
            sizes = np.array([len(base), len(other)])
            sig, who, role, slack = signatures(np.concatenate([base, other]), sizes, bands)
            shared = len(set(sig[who == 0].tolist()) & set(sig[who == 1].tolist()))
            assert shared >= max(1, min(slack[:, 0].min(), slack[:, 1].min()))
            least.append(slack[0, 0])
    assert np.mean(np.array(least) > 0) > 0.8, least  # few sets need their features as signatures


def test_losses_are_the_worst_case():
    for parts, lose in ((3, 1), (4, 2), (5, 3), (2, 1)):
        keep = parts - lose
        for m in range(1, parts + 1):
            left = [min(sum(1 for s in itertools.combinations(range(parts), keep) if not set(s) & set(hit) and any(k < m for k in s)) for hit in itertools.combinations(range(parts), d)) for d in range(lose + 1)]
            steps = [x for x, k in Bands(75, 10, parts, lose).losses() if k == m]
            assert len(steps) == lose + 1 and all(sum(steps[:d]) >= left[0] - left[d] for d in range(lose + 1)) and sum(steps) >= left[0]


def test_empty(spark):
    assert jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    f, n = shingle_sets([None, "", "a"])
    assert n.tolist() == [0, 0, 1] and len(f) == 1
