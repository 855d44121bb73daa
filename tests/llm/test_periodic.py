import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wayline.llm import periodic
from wayline.llm.periodic import op13_periodic_runs, periodic_runs, runs_of, words_of

SF = "/root/testdata/sf0.001"


def brute(words):
    """Every maximal stretch of each period, kept if no smaller period fits it."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        i = 0
        while i < n - q:
            if same[i]:
                j = i
                while same[j]:
                    j += 1
                length = j - i + q
                smallest = not any(all(words[k] == words[k + r] for k in range(i, i + length - r)) for r in range(1, q))
                if length >= max(6, 4 * q) and smallest:
                    out.append((i, length, q))
                i = j
            else:
                i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def coded(texts):
    words, ends = words_of(pa.array(texts, pa.string()))
    return words.dictionary_encode().indices.to_numpy().astype(np.int64), ends


def made(rng):
    """Texts of few words with planted powers, powers of powers, and shared stretches."""
    parts = []
    for _ in range(rng.randint(1, 5)):
        root = rng.choices("abc", k=rng.randint(1, 14))
        if rng.random() < 0.4:
            root = root * rng.randint(1, 5) + rng.choices("abcd", k=rng.randint(0, 2))
        parts += root * rng.randint(1, 8) + root[: rng.randint(0, len(root))]
        parts += rng.choices("abcdefgh", k=rng.randint(0, 6))
    return " ".join(parts)


@pytest.mark.parametrize("together", [1, 2, 6])
def test_runs_against_brute_force(monkeypatch, together):
    monkeypatch.setattr(periodic, "TOGETHER", together)
    rng = random.Random(together)
    texts = [made(rng) for _ in range(120)] + ["", "a", "a " * 5, "a " * 6, "a b " * 4, "a b c d " * 4 + "a", "x " * 300]
    codes, ends = coded(texts)
    got = [[] for _ in texts]
    first = [0, *ends.tolist()]
    for start, length, period in runs_of(codes, ends).tolist():
        t = int(np.searchsorted(ends, start, side="right"))
        got[t].append((start - first[t], length, period))
    for text, runs in zip(texts, got):
        assert runs == brute(text.split()), text


def test_every_place_moves_a_logarithmic_number_of_times(monkeypatch):
    moved = [0]
    unlink = periodic.Classes._unlink

    def counted(self, p, label):
        moved[0] += 1
        unlink(self, p, label)

    monkeypatch.setattr(periodic.Classes, "_unlink", counted)
    a, b = "a", "b"  # a Fibonacci word: squares everywhere, and as many splits as can be
    while len(b) < 20_000:
        a, b = b, b + a
    codes = np.frombuffer(b.encode(), np.uint8).astype(np.int64)
    runs_of(codes, np.array([len(codes)]))
    runs_of(np.tile(np.arange(700), 40), np.array([28_000]))
    assert moved[0] < 60_000 * np.log2(28_000)


def test_words_are_cut_at_ascii_white_space_only():
    texts = ["a b \x0bc\x0c\rd\te\x1cf g", None, "", "  \n ", "x", "  a\u0085 b  "]
    words, ends = words_of(pa.array(texts, pa.string()))
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert words.to_pylist() == [w for ws in want for w in ws] and ends.tolist() == np.cumsum([*map(len, want)]).tolist()


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_columns(spark):
    rows = [(1, "a b " * 5 + "c", 1), (2, None, 2), (2, None, 2), (3, "", 3), (None, "one  two", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Runs int")
    out = periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    got = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect())
    assert got == [(0, 2, [], "one two"), (1, 11, [(0, 10, 2)], "a b c"), (2, 0, [], ""), (2, 0, [], ""), (3, 0, [], "")]
    assert periodic_runs(docs.limit(0)).count() == 0


def test_the_strongest_run_is_compared_exactly(spark):
    big = 10**9
    runs = [(0, 4 * big - 1, big - 1), (5, 4 * big, big), (9, 8, 2), (12, 12, 3)]
    df = spark.createDataFrame([(runs,), ([],)], "runs array<struct<start: long, length: long, period: long>>")
    got = [r[0] and tuple(r[0]) for r in df.select(periodic.strongest(F.col("runs"))).collect()]
    want = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
    assert got == [want, None]


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    docs = [(d["doc_id"], " ".join((d["text"] or "").split(" ")[:150])) for d in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    docs += [(1000 + i, made(rng)) for i in range(100)] + [(5000, None), (5001, ""), (5003, "a"), (None, "a b " * 9), (7, "twice"), (7, "twice")]
    ids = [i for i in range(6000, 7000) if zlib.crc32(str(i).encode()) % 10 == 0][:5]
    docs += [(i, t) for i, t in zip(ids, [None, "", "one", "a  b", "w\n" * 40])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(collapsed(words, runs))))
    got = op13_periodic_runs(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and sum(w[1] > 0 for w in want) > 50
