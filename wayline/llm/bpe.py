"""Byte-level BPE: forced cuts between bytes that no token holds side by side, fragments encoded on their own."""

from __future__ import annotations

import heapq
import json
import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

MAX_VOCABULARY_BYTES = 64_000_000
#: A task remembers the fragments it met in two halves of so many; a full half replaces the older one.
MEMO = 120_000
#: Bytes of a column that are encoded or decoded at once.
BLOCK = 1_000_000
#: Slots, as a power of two, for the token counts of fragments of up to ``SHORT`` bytes; a task holds 20 bytes a slot.
COUNT_BITS, SHORT = 19, 15

NO_PAIR, NO_ID = np.iinfo(np.int64).max, (1 << 20) - 1
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

# Fixed values of byte-level BPE: the pattern that splits text before merging.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """The vocabulary, its merges and the table of forced cuts.

    A cut between two bytes is certain when no token holds them side by side: no merge can cross it.
    It is used only where the split into words is indifferent to it as well, so never inside a
    character, after white space, or before an apostrophe that does not follow a letter or digit.
    """

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE without a prefix space or normalizer is needed")
        alphabet = byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        named = {t: self.ids[as_bytes(t)] for t in model["vocab"]}
        self.ranks = {named[a] << 20 | named[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = [named[a + b] for a, b in pairs]
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self._hash_pairs()
        self._made, self._byte_ids = np.array(self.made, np.int64), np.array(self.byte_ids, np.int64)
        self.bytes_of = {i: t for t, i in self.ids.items()}
        if any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take white space or whole words are not known here")
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in added.items()}
        self.added = added
        self.added_pattern = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.pretoken = regex.compile(PRETOKEN)
        inside = np.zeros((256, 256), bool)
        for token in self.ids:
            b = np.frombuffer(token, np.uint8)
            inside[b[:-1], b[1:]] = True
        cut = ~inside
        cut[:, 0x80:0xC0] = False  # inside a character
        cut[0x80:, :] = False  # the character before may be white space outside ASCII
        cut[[*range(9, 14), *range(28, 33)], :] = False  # after white space
        alnum = [*range(48, 58), *range(65, 91), *range(97, 123)]
        cut[[b for b in range(256) if b not in alnum], ord("'")] = False
        self.cut = cut
        wide = ~inside
        wide[:0x80], wide[:, 0x80:0xC0], wide[:, ord("'")] = False, False, False
        self._cut, self._wide = cut.ravel(), wide.ravel()
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self._count_keys: tuple[np.ndarray, np.ndarray] | None = None

    def _hash_pairs(self) -> None:
        """The ranks of pairs of ids in an open table, a quarter of it filled at most."""
        codes, ranks = np.array(list(self.ranks), np.int64), np.array(list(self.ranks.values()), np.int64)
        self._pair_bits = max(4, (4 * len(codes)).bit_length())
        self._pair_codes, self._pair_ranks = np.full(1 << self._pair_bits, -1, np.int64), np.zeros(1 << self._pair_bits, np.int64)
        slot = self._pair_slots(codes)
        while len(codes):
            free = self._pair_codes[slot] < 0
            self._pair_codes[slot[free]] = codes[free]
            won = self._pair_codes[slot] == codes
            self._pair_ranks[slot[won]] = ranks[won]
            codes, ranks, slot = codes[~won], ranks[~won], (slot[~won] + 1) & ((1 << self._pair_bits) - 1)

    def _pair_slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._pair_bits)).astype(np.int64)

    def _pair_keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The rank of each pair above its place, so that the least is merged first; ``NO_PAIR`` for an unknown one."""
        code = left << 20 | right
        slot = self._pair_slots(code)
        held = self._pair_codes[slot]
        known = held == code
        out = np.where(known, self._pair_ranks[slot] << 32 | place, NO_PAIR)
        open_ = np.flatnonzero(~known & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self._pair_bits) - 1)
            held = self._pair_codes[slot[open_]]
            known = held == code[open_]
            at = open_[known]
            out[at] = self._pair_ranks[slot[at]] << 32 | place[at]
            open_ = open_[~known & (held >= 0)]
        return out

    def _cuts(self, b: np.ndarray) -> np.ndarray:
        """Whether the text may be cut after each byte but the last.

        After a character outside ASCII it may where the bytes allow it, the character can't be white
        space, all of which starts with the byte C2, E1, E2 or E3, and no apostrophe follows.
        """
        pair = b[:-1].astype(np.uint16) << 8 | b[1:]
        cut = self._cut[pair]
        if len(b) and b.max() >= 0x80:
            wide = self._wide[pair]
            wide[np.flatnonzero(b[:-2] == 0xC2) + 1] = False
            wide[np.flatnonzero((b[:-3] >= 0xE1) & (b[:-3] <= 0xE3)) + 2] = False
            cut |= wide
        return cut

    def fragments(self, text: bytes) -> list[bytes]:
        at = np.flatnonzero(self._cuts(np.frombuffer(text, np.uint8))) + 1
        ends = [*at.tolist(), len(text)]
        return [text[i:j] for i, j in zip([0, *ends], ends)]

    def _merge_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``words``, the longest first and none empty, and the number of ids of each.

        The pair of lowest rank, leftmost first, is joined in all words at once, so there are as many
        steps as the longest word needs. A joined id keeps the place of its left part, and only the
        ranks of its two neighbours are looked up again.
        """
        size = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(size)
        start = end - size
        n = int(end[-1])
        ids = np.full(n + 1, NO_ID, np.int64)
        ids[:n] = self._byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        place = np.arange(n + 1)
        after, before = place + 1, place - 1
        after[end - 1] = before[start] = after[n] = n
        key = self._pair_keys(ids, ids[after], place)
        at = start
        while len(at):
            least = np.minimum.reduceat(key[: end[-1]], at)
            go = least != NO_PAIR
            at, end, least = at[go], end[go], least[go]
            if not len(at):
                break
            i = least & 0xFFFFFFFF
            j = after[i]
            k = after[j]
            ids[i], ids[j], key[j] = self._made[least >> 32], NO_ID, NO_PAIR
            after[i], before[k] = k, i
            p = before[i]
            key[i] = self._pair_keys(ids[i], ids[k], i)
            key[p] = self._pair_keys(ids[p], ids[i], p)
        stay = ids[:n] != NO_ID
        return ids[:n][stay], np.add.reduceat(stay, start, dtype=np.int64)

    def _by_length(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """The places of the words to merge together, the longest first, and of those of over 100 bytes, which go one by one."""
        sizes = [*map(len, words)]
        short = sorted((i for i, n in enumerate(sizes) if 0 < n <= 100), key=sizes.__getitem__, reverse=True)
        return short, [i for i, n in enumerate(sizes) if n > 100]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as 32-bit integers: joins the pair of lowest rank, leftmost first, until no pair is known."""
        out: list[bytes] = [b""] * len(words)
        short, long = self._by_length(words)
        for i in long:
            out[i] = array("i", self._merge_long(words[i])).tobytes()
        if short:
            ids, size = self._merge_short([words[i] for i in short])
            raw, ends = ids.astype(np.int32).tobytes(), (4 * np.cumsum(size)).tolist()
            for i, start, end in zip(short, [0, *ends], ends):
                out[i] = raw[start:end]
        return out

    def count_all(self, words: list[bytes]) -> np.ndarray:
        """The number of ids that :meth:`merge_all` gives each word."""
        out = np.zeros(len(words), np.int64)
        short, long = self._by_length(words)
        for i in long:
            out[i] = len(self._merge_long(words[i]))
        if short:
            out[short] = self._merge_short([words[i] for i in short])[1]
        return out

    def _merge_long(self, word: bytes) -> list[int]:
        """A heap over a linked list: n log n for words of any length."""
        ranks = self.ranks
        parts: list[int | None] = [self.byte_ids[b] for b in word]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = self.made[rank], None, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) < n and (r := ranks.get(parts[left] << 20 | parts[right])) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p in parts if p is not None]

    def _words(self, fragments: list[bytes]) -> tuple[list[bytes], list[int]]:
        """The words of all fragments and where those of each end; ASCII letters after at most a space are one word."""
        words: list[bytes] = []
        ends = []
        for fragment in fragments:
            if fragment.isalpha() or (fragment[:1] == b" " and fragment[1:].isalpha()):
                words.append(fragment)
            else:
                words += [w.encode() for w in self.pretoken.findall(fragment.decode())]
            ends.append(len(words))
        return words, ends

    def encode_fragments(self, fragments: list[bytes]) -> list[bytes]:
        """The ids of each fragment as 32-bit integers."""
        words, ends = self._words(fragments)
        made = self.merge_all(words)
        return [made[i] if j - i == 1 else b"".join(made[i:j]) for i, j in zip([0, *ends], ends)]

    def count_fragments(self, fragments: list[bytes]) -> np.ndarray:
        """The number of ids of each fragment, each word merged once."""
        words, ends = self._words(fragments)
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        sums = np.concatenate([[0], np.cumsum(self.count_all(list(number))[which])])[[0, *ends]]
        return np.diff(sums)

    def count_many(self, texts: list[str]) -> np.ndarray:
        """The number of ids that :meth:`encode_many` gives each text, without making them.

        The fragments of all texts are looked up at once. One of up to ``SHORT`` bytes is known by
        its bytes and size, two 64-bit integers that are compared whole, and has one slot, where a
        later fragment may replace it; the others are merged, each once.
        """
        parts: list[bytes] = []
        of: list[int] = []
        out = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            at = 0
            for m in self.added_pattern.finditer(text) if self.added_pattern else ():
                parts.append(text[at : m.start()].encode())
                of.append(i)
                out[i] += 1
                at = m.end()
            parts.append(text[at:].encode())
            of.append(i)
        kept = [k for k, p in enumerate(parts) if p]
        if not kept:
            return out
        part_ends = np.cumsum([len(parts[k]) for k in kept])
        data = b"".join(parts)
        b = np.frombuffer(data, np.uint8)
        cut = self._cuts(b)
        cut[part_ends[:-1] - 1] = True
        end = np.append(np.flatnonzero(cut) + 1, len(b))
        counts = self._count_spans(data, np.concatenate([[0], end[:-1]]), end)
        first = np.concatenate([[0], np.searchsorted(end, part_ends)[:-1] + 1])
        np.add.at(out, np.array(of)[kept], np.add.reduceat(counts, first))
        return out

    def _count_spans(self, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self._count_keys is None:
            self._count_keys = np.zeros(1 << COUNT_BITS, np.uint64), np.zeros(1 << COUNT_BITS, np.uint64)
            self._counts = np.zeros(1 << COUNT_BITS, np.int32)
        size = end - start
        eight = np.ndarray((len(data) + 9,), "<u8", data + bytes(16), strides=(1,))
        low = eight[start] & _LOW_BYTES[np.minimum(size, 8)]
        high = eight[np.minimum(start + 8, len(data))] & _LOW_BYTES[np.clip(size - 8, 0, 7)] | np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
        slot = ((low ^ high * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)
        keys_low, keys_high = self._count_keys
        counts = self._counts[slot].astype(np.int64)
        new = np.flatnonzero((keys_low[slot] != low) | (keys_high[slot] != high) | (size > SHORT))
        if len(new):
            number: dict[bytes, int] = {}
            which = [number.setdefault(data[i:j], len(number)) for i, j in zip(start[new].tolist(), end[new].tolist())]
            counts[new] = self.count_fragments(list(number))[which]
            keep = new[size[new] <= SHORT]
            _, at = np.unique(slot[keep], return_index=True)  # one fragment a slot, for its three parts
            keep = keep[at]
            keys_low[slot[keep]], keys_high[slot[keep]], self._counts[slot[keep]] = low[keep], high[keep], counts[keep]
        return counts

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Fragments met before come from the memo, all others are merged together."""
        plain: list[list[bytes]] = []
        held: list[list[bytes | None]] = []
        open_at: list[list[int]] = []
        shape: list[list[int | bytes]] = []  # of each text: places in ``held``, or the id of an added token

        def part(text: str) -> int:
            plain.append(self.fragments(text.encode()) if text else [])
            return len(plain) - 1

        for text in texts:
            row: list[int | bytes] = []
            at = 0
            for m in self.added_pattern.finditer(text) if self.added_pattern else ():
                row += [part(text[at : m.start()]), np.int32(self.added[m[0]]).tobytes()]
                at = m.end()
            shape.append([*row, part(text[at:])])
        missing: dict[bytes, bytes] = {}
        for fragments in plain:
            found: list[bytes | None] = [*map(self.memo.get, fragments)]
            gaps = []
            for i in [i for i, v in enumerate(found) if v is None] if None in found else ():
                fragment = fragments[i]
                found[i] = old = self.older.get(fragment)
                if old is None:
                    missing[fragment] = b""
                    gaps.append(i)
                else:
                    self.memo[fragment] = old
            held.append(found)
            open_at.append(gaps)
        if missing:
            missing = dict(zip(missing, self.encode_fragments(list(missing))))
            for fragments, found, gaps in zip(plain, held, open_at):
                for i in gaps:
                    found[i] = missing[fragments[i]]
            self.memo.update((k, v) for k, v in missing.items() if len(k) <= 64)
        if len(self.memo) >= MEMO:
            self.older, self.memo = self.memo, {}
        return [np.frombuffer(b"".join([x if isinstance(x, bytes) else b"".join(held[x]) for x in row]), np.int32) for row in shape]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> str:
        try:
            parts = [*map(self.bytes_of.__getitem__, ids)]
        except KeyError:
            parts = [self.bytes_of.get(i, b"") for i in ids]
        return b"".join(parts).decode(errors="replace")


def load_vocabulary(path: str) -> str:
    """The tokenizer file's text, which is broadcast; its size is bounded by ``MAX_VOCABULARY_BYTES``."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has over {MAX_VOCABULARY_BYTES} bytes, too many for a vocabulary to broadcast")
    with open(path, encoding="utf-8") as f:
        return f.read()


_LOADED: dict[str, ByteBpe] = {}


def _loaded(held) -> ByteBpe:
    """One parsed vocabulary per broadcast and Python worker."""
    if held.value not in _LOADED:
        _LOADED[held.value] = ByteBpe(held.value)
    return _LOADED[held.value]


def _with_column(docs: DataFrame, name: str, kind: T.DataType, source: str, make: Callable[[ByteBpe, pa.Array], pa.Array], held) -> DataFrame:
    """``docs`` with ``name`` made from ``source``, a few megabytes at a time, so that a worker holds little besides its input."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    base = docs.select(*kept, docs[source].alias("__source"))
    schema = T.StructType([*(f for f in base.schema if f.name != "__source"), T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(held)
        for batch in batches:
            rows = max(1, batch.num_rows * BLOCK // max(1, batch.column(batch.num_columns - 1).nbytes))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], make(bpe, part.column(part.num_columns - 1))], names=schema.names)

    return base.mapInArrow(run, schema)


def bpe_encode(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds ``ids_col``, array<int>, the ids of every whole text; nothing shuffles and no row is dropped.

    ``vocabulary`` is a tokenizer file's text. A null text counts as empty; an empty text has no ids.
    The strings of added tokens in a text become those tokens. A column named ``ids_col`` is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make(bpe: ByteBpe, texts: pa.Array) -> pa.Array:
        ids = bpe.encode_many([t or "" for t in texts.to_pylist()])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids)))

    return _with_column(docs, ids_col, T.ArrayType(T.IntegerType()), text_col, make, held)


def bpe_count(docs: DataFrame, vocabulary: str, text_col: str = "text", count_col: str = "n_tokens") -> DataFrame:
    """Adds ``count_col``, long, the number of ids that :func:`bpe_encode` gives the whole text; the ids are not made."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return _with_column(docs, count_col, T.LongType(), text_col, lambda bpe, texts: pa.array(bpe.count_many([t or "" for t in texts.to_pylist()]), pa.int64()), held)


def bpe_decode(docs: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds ``text_col``, the text of ``ids_col``. Null ids give an empty text, unknown ids nothing, broken UTF-8 U+FFFD."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make(bpe: ByteBpe, rows: pa.Array) -> pa.Array:
        ids = rows.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        return pa.array([bpe.decode(ids[i:j].tolist()) for i, j in zip([0, *ends], ends)], pa.string())

    return _with_column(docs, text_col, T.StringType(), ids_col, make, held)


def public_vocabulary(path: str | None = None) -> str:
    """The vocabulary at ``path``, by default the public byte-level one of 50,257 ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return load_vocabulary(path)


def op7_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    vocabulary = public_vocabulary(path)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_decode(bpe_encode(docs, vocabulary).drop("text"), vocabulary)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
