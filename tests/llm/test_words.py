import random
import re

import numpy as np

from wayline.llm import words


def test_word_hashes_follow_the_words(monkeypatch):
    rng = random.Random(2)
    pieces = ["a", "A", "b", "é", "É", "日本", " ", "\t", "\n", "\x0b", "\x1c", " ", "zz"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 60))) for _ in range(300)] + [None, "", " ", "x" * 500, "y " * 300]
    want = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    flat = [w for ws in want for w in ws]
    for block in (2_000_000, 64):
        monkeypatch.setattr(words, "BLOCK", block)
        monkeypatch.setattr(words, "_powers", {})
        h, counts = words.word_hashes(texts)
        assert counts.tolist() == [len(w) for w in want]
        seen = {}
        for w, x in zip(flat, h.tolist()):
            assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


def test_counts_pack():
    v = np.array([0, 1, 254, 255, 256, 10**12])
    assert words.unpack_counts(*words.pack_counts(v)).tolist() == v.tolist()
    assert words.unpack_counts(*words.pack_counts(v[:0])).tolist() == []
