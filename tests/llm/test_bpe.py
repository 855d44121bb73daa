import random
import time

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from wayline.llm import bpe as module  # noqa: E402
from wayline.llm.bpe import ByteBpe, bpe_count, bpe_decode, bpe_encode, load_vocabulary  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["the", " and", "  ", "\n", "\n\n ", "\t", "'s", "!'s", "''ll", "x'", "don't", "é", "ß", "\u00a0", "\u3000", "\u2003a", "\x85", "12", " 3a", "...", "***", "###", "日本", "🙂", "👨‍👩‍👧", "\u0301", "Aa", "qxz", "<|endoftext|>", "<|endof", "@'re", "$$$ ", "\x00", "\x1c", "\x7f", "²", "ⅷ", "٣"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    made = ["".join(rng.choices(PARTS, k=rng.randint(1, 25))) for _ in range(4000)]
    made += ["".join(chr(rng.choice([rng.randint(1, 0x250), rng.randint(0x2000, 0x2100), 39, 32])) for _ in range(30)) for _ in range(4000)]
    return [*made, "", " ", "a" * 60_000, "ab " * 40_000, "!" * 30_000, " " * 20_000 + "x"]


def test_equals_the_library_and_round_trips(texts):
    bpe, library = ByteBpe(load_vocabulary(PATH)), Tokenizer.from_file(PATH)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = bpe.encode(text).tolist()
        assert ids == want.ids, text[:80]
        assert bpe.decode(ids) == library.decode(want.ids, skip_special_tokens=False) == text


def test_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 3), (2, None, 4), (2, None, 4), (3, "", 5)], "doc_id long, text string, ids int")
    vocabulary = load_vocabulary(PATH)
    out = bpe_decode(bpe_encode(docs, vocabulary), vocabulary).orderBy("doc_id").collect()
    assert [(r["doc_id"], len(r["ids"]), r["decoded"]) for r in out] == [(1, 2, "a b"), (2, 0, ""), (2, 0, ""), (3, 0, "")]
    assert bpe_encode(docs.limit(0), vocabulary).count() == 0
    odd = spark.createDataFrame([(None,), ([10**6],)], "ids array<int>")
    assert [r["decoded"] for r in bpe_decode(odd, vocabulary).collect()] == ["", ""]


@pytest.mark.parametrize("bits", [3, 19])
def test_counts_equal_the_library(texts, bits, monkeypatch):
    monkeypatch.setattr(module, "COUNT_BITS", bits)  # with eight slots nearly every fragment replaces another
    bpe, library = ByteBpe(load_vocabulary(PATH)), Tokenizer.from_file(PATH)
    short = [t for t in texts if len(t) < 1000] if bits == 3 else texts
    made = [*short, "\x00" * 3, "a\x00", "a", "a" * 8 + "\x00", "a" * 8, "a" * 15, "a" * 16, "é" * 200, "été", "×2", "naïve\u2003x", "ñ'lo", "\u07ff \u0800 x", *short[:3000]]
    want = [len(e.ids) for e in library.encode_batch(made, add_special_tokens=False)]
    for rows in (1, 7, 5000):
        some = made if rows > 1 else made[:1500]
        assert np.concatenate([bpe.count_many(some[i : i + rows]) for i in range(0, len(some), rows)]).tolist() == want[: len(some)]
    assert bpe.count_many([]).tolist() == [] and bpe.count_many(["", ""]).tolist() == [0, 0]


def test_counting_makes_no_ids(spark, monkeypatch):
    """The count was the length of the ids, which took more than its share of the time of packing."""
    bpe = ByteBpe(load_vocabulary(PATH))
    words = ["the", "and", "of", "reading", "table", "water", "house", "cité", "über", "señor"]
    rng = random.Random(5)
    many = [" ".join(rng.choices(words, k=300)) for _ in range(500)]

    def cpu(work):
        start = time.process_time()
        work()
        return time.process_time() - start

    made = {}
    monkeypatch.setattr(module, "_with_column", lambda docs, name, kind, source, make, held: made.setdefault("make", make))
    bpe_count(spark.createDataFrame([("a",)], "text string"), "")
    count = lambda: made["make"](bpe, module.pa.array(many))
    assert count().to_pylist() == [len(x) for x in bpe.encode_many(many)]
    assert min(cpu(count) for _ in range(5)) < 0.6 * min(cpu(lambda: bpe.encode_many(many)) for _ in range(5))


def test_fragments_end_after_letters_outside_ascii():
    bpe = ByteBpe(load_vocabulary(PATH))
    split = lambda text: [f.decode() for f in bpe.fragments(text.encode())]
    assert split("cité de") == ["cité", " de"] and split("été là") == ["été", " là"]
    for space in "\x85\u00a0\u1680\u2003\u2028\u202f\u205f\u3000":
        assert split(f"x{space} a")[-1].endswith(f"{space} a")  # never cut after white space
    assert split("é's")[-1].endswith("é's")


def test_merging_at_once_equals_merging_one_by_one():
    bpe, rng = ByteBpe(load_vocabulary(PATH)), random.Random(11)
    words = [bytes(rng.choices(b" aeinrst\xc3\xa9\xe2\x80.'0", k=rng.randint(0, 101))) for _ in range(2000)] + [b"", b"a", b"aaaa" * 25, b"z" * 300]
    want = [bpe._merge_long(w) for w in words]
    assert [np.frombuffer(x, np.int32).tolist() for x in bpe.merge_all(words)] == want
    assert bpe.count_all(words).tolist() == [len(w) for w in want]
    assert bpe.merge_all([]) == [] and bpe.count_all([b""]).tolist() == [0]
