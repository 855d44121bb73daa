"""SentencePiece BPE: a table of distinct marked words, each segmented once, ids joined back by position.

White space marks only ever begin a piece (or make up all of it), so no merge crosses the place where a
run of marks follows another character. Texts are cut there, and equal cuts have equal ids wherever they
stand. Each task keeps the table of the marked words that it met; the words of a batch are looked up by
their distinct values and the ids return to the words' places with one gather.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from .common import read

MAX_MODEL_BYTES = 64_000_000
#: A task's table of marked words is two halves of so many entries of up to ``LONG`` characters; a full half replaces the older one.
TABLE = 200_000
LONG = 64
#: Words of more symbols than this are merged one by one with a heap, the others all at once.
AT_ONCE = 100
#: Bytes of a column that are encoded or decoded at once.
BLOCK = 2_000_000

# Fixed values of the model format: the white space mark, the surface of the unknown piece, the kinds of pieces and of models.
MARK, UNKNOWN_SURFACE = "▁", " ⁇ "
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2


class PieceBpe:
    """A model's pieces, which pairs of them join, and the table of marked words."""

    def __init__(self, serialized: bytes):
        model = sentencepiece_model_pb2.ModelProto.FromString(serialized)
        norm, trainer, pieces = model.normalizer_spec, model.trainer_spec, model.pieces
        if trainer.model_type != BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback and marks before words is needed")
        if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only the identity normalizer with a dummy prefix is known here")
        if {p.type for p in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not known here")
        ids = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("pieces that cross a white space mark can't be cut there")
        self.bos, self.eos = trainer.bos_id, trainer.eos_id
        control = {i for i, p in enumerate(pieces) if p.type == CONTROL}
        self.control, self.marked = control, {i for p, i in ids.items() if p.startswith(MARK)}
        surface = lambda i, p: b"" if i in control else UNKNOWN_SURFACE.encode() if p.type == UNKNOWN else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode()
        self.bytes_of = [surface(i, p) for i, p in enumerate(pieces)]
        self.byte_ids = np.zeros(256, np.int64)
        self.is_byte = [p.type == BYTE for p in pieces]
        for i, p in enumerate(pieces):
            if p.type == BYTE:
                self.byte_ids[self.bytes_of[i][0]] = i
        if {c for p in ids for c in p} - set(ids):
            raise ValueError("characters that only longer pieces have are not known here")
        if len(pieces) >= 1 << 20:
            raise ValueError("too many pieces")
        chars = sorted((ord(p), i) for p, i in ids.items() if len(p) == 1)
        self._chars, self._char_ids = np.array([c for c, _ in chars], np.uint32), np.array([i for _, i in chars], np.int64)
        place = {s: k for k, s in enumerate(sorted({pieces[i].score for i in ids.values()}, reverse=True))}
        pairs = {ids[p[:k]] << 20 | ids[p[k:]]: (place[pieces[i].score], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self.pairs, self.none = pairs, len(place)
        # the pairs by hash: a slot's code, rank and piece; a taken slot sends to the next one
        self._shift = np.uint64(64 - max(8, (8 * len(pairs)).bit_length()))
        self._slots = np.full(1 << (64 - int(self._shift)), -1, np.int64)
        self._values = np.zeros((len(self._slots), 2), np.int64)
        for code, value in pairs.items():
            at = int(self._slot(np.array([code]))[0])
            while self._slots[at] >= 0:
                at = (at + 1) % len(self._slots)
            self._slots[at], self._values[at] = code, value
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.segmented = 0

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def _join(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair, ``none`` if no piece is made of it, and the piece."""
        code = np.where((left < 0) | (right < 0), -2, left << 20 | right)
        at = self._slot(code)
        held = self._slots[at]
        while len(lost := np.flatnonzero((held != code) & (held >= 0))):
            at[lost] = (at[lost] + 1) % len(self._slots)
            held[lost] = self._slots[at[lost]]
        rank, made = self._values[at].T
        return np.where(held == code, rank, self.none), made

    def _symbols(self, text: str) -> np.ndarray:
        """A symbol a character; those that no piece has are ``-1 - character``."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self._chars, points), len(self._chars) - 1)
        return np.where(self._chars[at] == points, self._char_ids[at], -1 - points.astype(np.int64))

    def _finish(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their words: characters that no piece has become their bytes."""
        odd = np.flatnonzero(symbols < 0)
        if not len(odd):
            return symbols, word
        raw = [chr(p).encode(errors="surrogatepass") for p in (-1 - symbols[odd]).tolist()]
        size = np.ones(len(symbols), np.int64)
        size[odd] = [*map(len, raw)]
        out = np.repeat(symbols, size)
        out[out < 0] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.repeat(word, size)

    def segment(self, words: list[str]) -> list[bytes]:
        """The ids of each marked word, given without its first mark, as 32-bit integers.

        Joins the pair of the best score, leftmost first, until no pair makes a piece; one such step is taken in all words at once.
        """
        self.segmented += len(words)
        marked = [MARK + w.replace(" ", MARK) for w in words]
        long = [i for i, w in enumerate(marked) if len(w) > AT_ONCE]
        which = np.array([i for i, w in enumerate(marked) if len(w) <= AT_ONCE], np.int64)
        size = np.array([len(marked[i]) for i in which.tolist()], np.int64)
        ids = self._symbols("".join([marked[i] for i in which.tolist()]))
        done_ids, done_word = [], []
        for i in long:
            merged = self._merge_long(self._symbols(marked[i]).tolist())
            done_ids.append(np.array(merged, np.int64))
            done_word.append(np.full(len(merged), i))
        last = np.cumsum(size) - 1
        rank, made = self._join(ids, np.append(ids[1:], -1))
        rank[last] = self.none
        while len(which):
            start = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, start)
            ended = best == self.none
            if ended.any():
                over = np.repeat(ended, size)
                done_ids.append(ids[over])
                done_word.append(np.repeat(which[ended], size[ended]))
                go = ~ended
                ids, rank, made, which, best, size = ids[~over], rank[~over], made[~over], which[go], best[go], size[go]
            word = np.repeat(np.arange(len(which)), size)
            hits = np.flatnonzero(rank == best[word])
            first = np.ones(len(hits), bool)
            first[1:] = word[hits[1:]] != word[hits[:-1]]
            hits = hits[first]
            ids[hits] = made[hits]
            stay = np.ones(len(ids), bool)
            stay[hits + 1] = False
            ids, rank, made, word, size = ids[stay], rank[stay], made[stay], word[stay], size - 1
            # one hit a word: its place is now that many earlier; only the pairs on its sides are new
            at = hits - np.arange(len(hits))
            at = np.concatenate([at, at[at > 0] - 1])
            after = np.minimum(at + 1, len(ids) - 1)
            new, piece = self._join(ids[at], ids[after])
            rank[at], made[at] = np.where((word[at] == word[after]) & (after > at), new, self.none), piece
        if not done_ids:
            return []
        flat, word = self._finish(np.concatenate(done_ids), np.concatenate(done_word))
        order = np.argsort(word, kind="stable")
        raw = flat[order].astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends)]

    def _merge_long(self, parts: list[int | None]) -> list[int]:
        """A heap over a linked list: n log n for words of any length."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            a, b = parts[i], parts[j]
            if a >= 0 and b >= 0 and (found := self.pairs.get(a << 20 | b)):
                heapq.heappush(heap, (found[0], i, a, b, found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = made, None, after[j]
            if after[j] < n:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def _lookup(self, distinct: list[str]) -> list[bytes]:
        """The ids of distinct marked words: from the table, or segmented now and put there."""
        found = [*map(self.table.get, distinct)]
        missing = []
        for i in [i for i, v in enumerate(found) if v is None] if None in found else ():
            found[i] = old = self.older.get(distinct[i])
            if old is None:
                missing.append(i)
            else:
                self.table[distinct[i]] = old
        for i, ids in zip(missing, self.segment([distinct[i] for i in missing])):
            found[i] = ids
            if len(distinct[i]) <= LONG:
                self.table[distinct[i]] = ids
        if len(self.table) >= TABLE:
            self.older, self.table = self.table, {}
        return found

    def encode_many(self, texts: pa.Array, add_ends: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of ids of each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        some = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        marked = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.filter(pa.array(some)), pa.scalar("", pa.large_string()))
        # the first mark of every run ends the word before it; the others stay with the word behind them
        marked = pc.replace_substring_regex(pc.replace_substring(marked, MARK, " "), r" ( *)", MARK + r"\1")
        words = pc.split_pattern(marked, MARK)
        offsets = words.offsets.to_numpy()
        flat = words.values.slice(offsets[0], offsets[-1] - offsets[0])
        n_words = np.diff(offsets) - 1  # the first is the nothing before the dummy prefix
        keep = np.ones(len(flat), bool)
        keep[offsets[:-1] - offsets[0]] = False
        coded = flat.filter(pa.array(keep)).dictionary_encode()
        found = self._lookup(coded.dictionary.to_pylist())
        table = np.frombuffer(b"".join(found), "<i4")
        size = np.array([len(b) // 4 for b in found], np.int64)
        start = np.cumsum(size) - size
        code = coded.indices.to_numpy()
        taken = size[code]
        of_text = np.zeros(len(some), np.int64)
        ends = np.concatenate([[0], np.cumsum(taken)])
        of_text[some] = np.diff(ends[np.concatenate([[0], np.cumsum(n_words)])])
        ids = table[np.repeat(start[code] - ends[:-1], taken) + np.arange(ends[-1])]
        if add_ends:
            whole = of_text + 2
            stop = np.cumsum(whole)
            out = np.full(int(whole.sum()), self.bos, np.int32)
            out[stop - 1] = self.eos
            inner = np.ones(len(out), bool)
            inner[stop - 1] = inner[stop - whole] = False
            out[inner] = ids
            return out, whole
        return ids.astype(np.int32), of_text

    def decode(self, ids: list[int]) -> str:
        """The text of ids; those out of range give nothing, broken UTF-8 one U+FFFD a byte."""
        n = len(self.bytes_of)
        end = len(ids)
        while end and ids[end - 1] in self.control:
            end -= 1
        ids = ids[:end]
        if ids and not (0 <= min(ids) and max(ids) < n):
            ids = [i for i in ids if 0 <= i < n]
        raw = b"".join([*map(self.bytes_of.__getitem__, ids)])
        first = next((i for i in ids if i not in self.control), -1)
        cut = first in self.marked  # the dummy prefix
        try:
            text = raw.decode()
            # a control id between bytes keeps them apart
            if not self.control.isdisjoint(ids[1:]):
                text = self._decode_broken(ids)
        except UnicodeDecodeError:
            text = self._decode_broken(ids)
        return text[1:] if cut else text

    def _decode_broken(self, ids: list[int]) -> str:
        out, run = [], b""
        for i in [*ids, -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.bytes_of[i]
                continue
            while run:
                for k in (1, 2, 3, 4):  # the length of a character
                    try:
                        out.append(run[:k].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    k = 1
                    out.append("�")
                run = run[k:]
            if i >= 0:
                out.append(self.bytes_of[i].decode())
        return "".join(out)


_LOADED: dict[bytes, PieceBpe] = {}


def _loaded(held) -> PieceBpe:
    """One parsed model per broadcast and Python worker."""
    if held.value not in _LOADED:
        _LOADED[held.value] = PieceBpe(held.value)
    return _LOADED[held.value]


def load_model(path: str) -> bytes:
    """The model file, which is broadcast; its size is bounded by ``MAX_MODEL_BYTES``."""
    with open(path, "rb") as f:
        serialized = f.read(MAX_MODEL_BYTES + 1)
    if len(serialized) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} has over {MAX_MODEL_BYTES} bytes, too many for a model to broadcast")
    return serialized


def public_model(path: str | None = None) -> bytes:
    """The model at ``path``, by default the public one of 32,000 pieces."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return load_model(path)


def _with_column(docs: DataFrame, name: str, kind: T.DataType, source: str, make: Callable[[PieceBpe, pa.Array], pa.Array], model: bytes) -> DataFrame:
    """``docs`` with ``name`` made from ``source``, a few megabytes at a time; nothing shuffles and no row is dropped."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    base = docs.select(*[docs[f"`{c}`"] for c in kept], docs[f"`{source}`"].alias("__source"))
    schema = T.StructType([*base.schema.fields[:-1], T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(held)
        for batch in batches:
            rows = max(1, batch.num_rows * BLOCK // max(1, batch.column(batch.num_columns - 1).nbytes))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], make(bpe, part.column(part.num_columns - 1))], names=schema.names)

    return base.mapInArrow(run, schema)


def piece_encode(docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids", add_ends: bool = True, packed: bool = False) -> DataFrame:
    """Adds ``ids_col``, the ids of every whole text, with the begin and end ids if ``add_ends``.

    The ids are array<int>, or with ``packed`` the little-endian 32-bit integers of token files as binary. A null
    text counts as empty; an empty text has the begin and end ids only. Repeated rows, extra columns and empty tables
    pass through; a column named ``ids_col`` is replaced. Very long texts and words cost n log n.
    """

    def make(bpe: PieceBpe, texts: pa.Array) -> pa.Array:
        ids, size = bpe.encode_many(texts, add_ends)
        ends = np.concatenate([[0], np.cumsum(size)])
        if packed:
            return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids.astype("<i4"))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))

    return _with_column(docs, ids_col, T.BinaryType() if packed else T.ArrayType(T.IntegerType()), text_col, make, model)


def piece_decode(docs: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds ``text_col``, the text of ``ids_col`` (either form of :func:`piece_encode`).

    The dummy prefix, begin and end vanish, the unknown id has its surface. Null ids give an empty text, ids out of
    range or null nothing, broken UTF-8 one U+FFFD a byte.
    """

    def make(bpe: PieceBpe, rows: pa.Array) -> pa.Array:
        if pa.types.is_binary(rows.type):
            return pa.array([bpe.decode(np.frombuffer(b, "<i4").tolist() if b else []) for b in rows.to_pylist()], pa.string())
        ids = pc.fill_null(rows.flatten(), -1).to_numpy(zero_copy_only=False)
        ends = np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        return pa.array([bpe.decode(ids[i:j].tolist()) for i, j in zip([0, *ends], ends)], pa.string())

    return _with_column(docs, text_col, T.StringType(), ids_col, make, model)


def op12_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    model = public_model(path)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = piece_decode(piece_encode(docs, model, packed=True).drop("text"), model)
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), digest("ids").alias("ids_sha256"), digest("decoded").alias("decoded_sha256"))
