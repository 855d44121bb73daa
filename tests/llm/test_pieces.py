import glob
import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

from wayline.llm.pieces import PieceBpe, load_model, op12_sentencepiece, piece_decode, piece_encode  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
PARTS = ["the", " and", "  ", "\n", "▁", "▁▁", "\t", "é", " ", "日本", "🙂", "👨‍👩‍👧", "́", "\x00", "<s>", "</s>", "<0x0A>", "<unk>", "12", "   ", "a", "qxz", "ⅷ", "퟿", "�", "\U0010ffff", "x" * 120]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def encode(bpe, texts, add_ends=True):
    ids, size = bpe.encode_many(pa.array(texts, pa.string()), add_ends)
    ends = np.cumsum(size).tolist()
    return [ids[i:j].tolist() for i, j in zip([0, *ends], ends)]


def test_equals_the_library(library):
    rng = random.Random(3)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(1, 25))) for _ in range(3000)]
    texts += ["", None, " ", "  ", "a" * 60_000, "ab " * 40_000, " " * 20_000 + "x", "x" + " " * 5000, "日本" * 3000, "▁" * 300]
    bpe = PieceBpe(load_model(PATH))
    for text, got, bare in zip(texts, encode(bpe, texts), encode(bpe, texts, False)):
        want = library.encode(text or "", add_bos=True, add_eos=True)
        assert got == want and bare == want[1:-1], (text or "")[:80]
        assert bpe.decode(got) == library.decode(want)


def test_ids_of_any_kind_decode_as_the_library_does(library):
    rng, bpe = random.Random(5), PieceBpe(load_model(PATH))
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), 28705, 259]) for _ in range(rng.randint(0, 8))]
        assert bpe.decode(ids) == library.decode(ids), ids
    assert bpe.decode([-1, 10**6]) == ""


def test_each_distinct_marked_word_is_segmented_once():
    bpe = PieceBpe(load_model(PATH))
    encode(bpe, ["one two one", "two  one"] * 50)
    encode(bpe, ["one", "two"])
    assert bpe.segmented == 3  # one, two, and one after two marks


def test_a_full_table_changes_no_result(monkeypatch):
    texts = [" ".join(f"w{i * k % 97}" for i in range(60)) for k in range(60)]
    want = encode(PieceBpe(load_model(PATH)), texts)
    monkeypatch.setattr("wayline.llm.pieces.TABLE", 7)
    small = PieceBpe(load_model(PATH))
    assert [encode(small, [t])[0] for t in texts] == want and len(small.table) < 70


@pytest.mark.parametrize("packed", [False, True])
def test_columns(spark, library, packed):
    rows = [(1, "a b", 3), (2, None, 4), (2, None, 4), (3, "", 5), (None, "x\n y", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS int")
    model = load_model(PATH)
    out = piece_decode(piece_encode(docs, model, packed=packed), model)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = out.collect()
    ids = [np.frombuffer(r["ids"], "<i4").tolist() if packed else r["ids"] for r in got]
    assert sorted(zip([r["decoded"] for r in got], ids)) == sorted((t or "", library.encode(t or "", add_bos=True, add_eos=True)) for _, t, _ in rows)
    assert piece_encode(docs.limit(0), model, packed=packed).count() == 0
    odd = spark.createDataFrame([(None,), ([10**6, None],)], "ids array<int>")
    assert [r["decoded"] for r in piece_decode(odd, model).collect()] == ["", ""]


def test_query_against_the_library(spark, library):
    docs = pq.read_table(glob.glob(f"{SF}/documents.parquet")[0], columns=["doc_id", "text"]).to_pylist()
    want = []
    for d in docs:
        ids = library.encode(d["text"] or "", add_bos=True, add_eos=True)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want.append((d["doc_id"], len(ids), digest(np.array(ids, "<u4").tobytes()), digest(library.decode(ids).encode())))
    assert sorted(map(tuple, op12_sentencepiece(spark, SF).collect())) == sorted(want)
