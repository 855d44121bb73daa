"""Hashes of the words of whole texts, vectorised; used inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

#: Bytes that are hashed at once.
BLOCK = 2_000_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FOLD = np.arange(1, 257, dtype=_U)
_FOLD[65:91] += _U(32)
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits, one to one."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.ones(max(n, BLOCK), _U)
        k = 1
        while k < len(held):
            m = min(k, len(held) - k)
            held[k : k + m] = held[:m] * _U(pow(base, k, 1 << 64))
            k += m
        if n <= 4 * BLOCK:
            _powers[base] = held
    return held[:n]


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(_BASE) + _U(seed)) | _U(1)


def _pieces(texts: Iterable[str | None]) -> Iterator[tuple[int, bytes]]:
    """(text number, bytes) with no word cut, of about ``BLOCK`` bytes at most unless one word is longer."""
    for i, text in enumerate(texts):
        b = (text or "").encode(errors="surrogatepass")
        at = 0
        while len(b) - at > BLOCK:
            space = _SPACE[np.frombuffer(b, np.uint8, -1, at)]
            k = BLOCK - int(space[:BLOCK][::-1].argmax()) if space[:BLOCK].any() else int(space.argmax()) + 1
            if not space.any():
                break
            yield i, b[at : at + k]
            at += k
        yield i, b[at:]


def _hash_block(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(p) + 1 for p in pieces])
    buf = np.frombuffer(b" ".join(pieces) + b" ", np.uint8)
    space = _SPACE[buf]
    edge = np.diff(space.astype(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(buf) + 1, _U)
    np.cumsum(_FOLD[buf] * _power(_BASE, len(buf)), out=sums[1:])
    h = (sums[end] - sums[start]) * _power(_INVERSE, len(buf))[start]
    return mix(h), np.searchsorted(ends, start, side="right")


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of all texts in order, and the number of words of each text.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased; null counts as empty.
    """
    hashes, counts = [], np.zeros(len(texts), np.int64)
    block: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal block, size
        h, which = _hash_block([b for _, b in block])
        hashes.append(h)
        np.add.at(counts, np.array([i for i, _ in block])[which], 1)
        block, size = [], 0

    for i, piece in _pieces(texts):
        block.append((i, piece))
        size += len(piece) + 1
        if size >= BLOCK:
            flush()
    if block:
        flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, _U)), counts


def arrow_blocks(texts: pa.Array, size: int = 4_000_000, rows: int = 30_000) -> Iterator[slice]:
    """Slices of consecutive texts with about ``size`` bytes each, one longer text at least, and ``rows`` texts at most."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = min(int(np.searchsorted(ends, before + size)) + 1, start + rows, len(texts))
        yield slice(start, stop)
        start = stop


def part_of(column: pa.Array, part: slice) -> list:
    return column.slice(part.start, part.stop - part.start).to_pylist()


def pack_counts(values: np.ndarray) -> tuple[bytes, bytes]:
    """Non-negative counts as one byte each, compressed, and apart the positions and values of those over 254."""
    large = np.flatnonzero(values >= 255)
    small = values.copy()
    small[large] = 255
    return zstandard.compress(small.astype(np.uint8).tobytes(), 1), np.stack([large.astype(np.int64), values[large].astype(np.int64)]).tobytes()


def unpack_counts(small: bytes, large: bytes) -> np.ndarray:
    values = np.frombuffer(zstandard.decompress(small), np.uint8).astype(np.int64)
    where, what = np.frombuffer(large, np.int64).reshape(2, -1)
    values[where] = what
    return values


def pack_keys(keys: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted 64-bit keys as their low bytes and the gaps between the rest, of one byte each but for the far ones."""
    if not len(keys):
        return b"", b"", b""
    spread = max(1, int(keys[-1] - keys[0]) // len(keys)).bit_length()  # of a usual gap
    low = max(0, min(7, -(-(spread - 5) // 8)))
    high = (keys >> _U(8 * low)).astype(np.int64) if low else keys.view(np.int64)
    gaps, far = pack_counts(np.diff(high, prepend=high[:1]))
    return np.uint64(keys[0]).tobytes() + keys.view(np.uint8).reshape(-1, 8)[:, :low].tobytes(), gaps, far


def unpack_keys(low: bytes, gaps: bytes, far: bytes) -> np.ndarray:
    if not gaps:
        return np.zeros(0, _U)
    high = np.cumsum(unpack_counts(gaps, far)).astype(_U)
    width = (len(low) - 8) // len(high)
    high += np.frombuffer(low[:8], _U)[0] >> _U(8 * width)
    out = np.zeros((len(high), 8), np.uint8)
    out[:, :width] = np.frombuffer(low, np.uint8, offset=8).reshape(len(high), width)
    return out.view(_U).ravel() + (high << _U(8 * width))
