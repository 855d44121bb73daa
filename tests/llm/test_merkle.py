import hashlib
import random
import zlib

import duckdb
import pytest

from wayline.llm import merkle
from wayline.llm.merkle import OP11_SQL, merkle_manifest, op11_merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """The root, and each node's proof as (left, right) pairs."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for k, p in enumerate(at):
            proofs[k].append(("".join(runs[p // 3][: p % 3]), "".join(runs[p // 3][p % 3 + 1 :])))
        at, level = [p // 3 for p in at], [sha(*r) for r in runs]
    return (level[0] if level else None), proofs


def brute(rows):
    def leaf(d):
        return sha(*["-" if d[c] is None else f"{len(str(d[c]).encode())}:{d[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")])

    groups = {}
    for r in rows:
        d = dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r))
        groups.setdefault(d["source"], []).append((d["doc_id"] is not None, d["doc_id"] or 0, leaf(d), d))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([m[2] for m in sorted(groups[s], key=lambda m: m[:3])]) for s in order]
    root, outer = tree([t[0] for t in trees])
    out = []
    for s, (subroot, proofs), top in zip(order, trees, outer):
        for (_, _, h, d), proof in zip(sorted(groups[s], key=lambda m: m[:3]), proofs):
            proof = proof + top
            tampered = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 2 == 0
            node = leaf(d | {"text": d["text"] and d["text"].replace("\n", "")}) if tampered else h
            for left, right in proof:
                node = sha(left, node, right)
            out.append((d["doc_id"], h, subroot, root, sha(*[x for p in proof for x in p]), node, node == root))
    return sorted(out, key=str)


def made(sizes):
    rng = random.Random(sum(sizes))
    rows = []
    for k, n in enumerate(sizes):
        source = [None, "", "é", "src", "Src", "zz"][k % 6]
        for i in range(n):
            text = rng.choice([None, "", "a\nb", "plain", "\n", "日本\n語", "x" * 500])
            rows.append((rng.choice([rng.randrange(10**6), i, -i, None if i % 50 == 7 else i]), text, rng.choice(["en", None]), source, rng.choice([None, 3, -1])))
    rows += rows[:3]
    rng.shuffle(rows)
    return rows


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("sizes,levels", [([1], 5), ([3], 5), ([1, 1], 5), ([40, 5, 27, 28, 1, 9], 1), ([40, 5, 27, 28, 1, 9], 2), ([300, 1, 243, 4], 5)])
def test_query_and_sql_against_brute_force(spark, tmp_path, monkeypatch, sizes, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = made(sizes)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = op11_merkle(spark, str(tmp_path))
    assert out.columns == COLUMNS
    want = brute(rows)
    assert sorted(map(tuple, out.collect()), key=str) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP11_SQL})").fetchall()
    assert sorted(got, key=str) == want


def test_one_row_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)], SCHEMA)
    named = docs.selectExpr("*", "1 AS leaf", "2 AS place", "3 AS tree", "4 AS size", "5 AS __at")
    row = merkle_manifest(named).collect()[0]
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof"] == []
    assert merkle_manifest(docs.limit(0)).count() == 0
