"""HTML extraction: a linear-chain conditional random field over leaf blocks, decoded by Viterbi."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .html_blocks import BIT, MARKS, MEMO, Block, leaf_blocks
from .html_training import training_pages

#: The field is trained on this many labelled pages at most, the first ones given.
MAX_LABELLED = 5_000


class Field(NamedTuple):
    """Log-potentials of the two labels, other (0) and main (1).

    ``weights`` of a mark add to main; ``step[a][b]`` is that of label b after a.
    """

    weights: tuple[float, ...]
    step: tuple[tuple[float, float], tuple[float, float]]


def block_labels(blocks: list[Block], main_text: str) -> np.ndarray:
    """1 for each block whose text is a block of ``main_text`` (blocks joined by an empty line), as often as it is there."""
    left = Counter(main_text.split("\n\n"))
    labels = np.zeros(len(blocks), np.int64)
    for i, b in enumerate(blocks):
        if left[b.text] > 0:
            left[b.text] -= 1
            labels[i] = 1
    return labels


def train_field(labelled: Iterable[tuple[str, str]], penalty: float = 0.02, steps: int = 300, max_labelled: int = MAX_LABELLED) -> Field:
    """Maximises the penalised conditional likelihood of labelled pages (html, main text) by accelerated gradient.

    Pages without blocks teach nothing; without any page all potentials are 0, which extracts nothing.
    """
    pages = []
    for k, (page, text) in enumerate(labelled):
        if k == max_labelled:
            break
        if blocks := leaf_blocks(page):
            pages.append((blocks, block_labels(blocks, text)))
    if not pages:
        return Field((0.0,) * len(MARKS), ((0.0, 0.0), (0.0, 0.0)))
    n, longest = len(pages), max(len(b) for b, _ in pages)
    masks = sorted({b.marks for blocks, _ in pages for b in blocks})
    row = {m: i for i, m in enumerate(masks)}
    x = np.array([[m >> k & 1 for k in range(len(MARKS))] for m in masks], float)
    which, y, there = np.zeros((n, longest), np.int64), np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (blocks, labels) in enumerate(pages):
        which[i, : len(blocks)], y[i, : len(blocks)], there[i, : len(blocks)] = [row[b.marks] for b in blocks], labels, True
    total = there.sum()
    seen = np.bincount(which[there], y[there], len(masks))
    pairs = there[:, 1:]
    moved = np.zeros((2, 2))
    np.add.at(moved, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)

    def gradient(w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = (x @ w)[which]
        forward, backward = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
        forward[0, :, 1] = score[:, 0]
        for k in range(1, longest):
            new = np.logaddexp(forward[k - 1, :, 0, None] + t[0], forward[k - 1, :, 1, None] + t[1])
            new[:, 1] += score[:, k]
            forward[k] = np.where(there[:, k, None], new, forward[k - 1])
        for k in range(longest - 2, -1, -1):
            after = backward[k + 1].copy()
            after[:, 1] += score[:, k + 1]
            new = np.logaddexp(t[:, 0] + after[:, 0, None], t[:, 1] + after[:, 1, None])
            backward[k] = np.where(there[:, k + 1, None], new, 0.0)
        z = np.logaddexp(forward[-1, :, 0], forward[-1, :, 1])
        main = np.exp(forward[:, :, 1] + backward[:, :, 1] - z).T
        expected = np.bincount(which[there], main[there], len(masks))
        after = backward[1:].copy()
        after[:, :, 1] += score.T[1:]
        both = np.exp(forward[:-1, :, :, None] + t + after[:, :, None, :] - z[:, None, None]) * pairs.T[:, :, None, None]
        return (x.T @ (seen - expected)) / total - penalty / 100 * w, (moved - both.sum(axis=(0, 1))) / total - penalty / 100 * t

    w, t = np.zeros(len(MARKS)), np.zeros((2, 2))
    first, second = [np.zeros_like(w), np.zeros_like(t)], [np.zeros_like(w), np.zeros_like(t)]
    for k in range(1, steps + 1):
        for v, g, m, s in zip((w, t), gradient(w, t), first, second, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    return Field(tuple(map(float, w)), ((float(t[0, 0]), float(t[0, 1])), (float(t[1, 0]), float(t[1, 1]))))


def viterbi(scores: list[float], step: tuple[tuple[float, float], tuple[float, float]]) -> list[bool]:
    """The likeliest labels of a chain; on ties a block is other."""
    (oo, om), (mo, mm) = step
    back = []
    other = main = 0.0
    for k, s in enumerate(scores):
        if k == 0:
            main = s
            continue
        from_main_o, from_main_m = main + mo > other + oo, main + mm > other + om
        back.append((from_main_o, from_main_m))
        other, main = (main + mo if from_main_o else other + oo), (main + mm if from_main_m else other + om) + s
    out, at = [], main > other
    for from_main in reversed(back):
        out.append(at)
        at = from_main[at]
    return [*([at] if scores else []), *reversed(out)]


class Extractor:
    """A field with the scores of the masks it has met."""

    def __init__(self, field: Field):
        self.field = field
        self.known: dict[int, float] = {}

    def score(self, marks: int) -> float:
        if (held := self.known.get(marks)) is None:
            held = sum(w for k, w in enumerate(self.field.weights) if marks >> k & 1)
            if len(self.known) < MEMO:
                self.known[marks] = held
        return held

    def main_text(self, page: str | None) -> str:
        blocks = leaf_blocks(page)
        main = viterbi([self.score(b.marks) for b in blocks], self.field.step)
        return "\n\n".join(b.text for b, m in zip(blocks, main) if m)


def extract_main_text(pages: DataFrame, field: Field, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Adds ``text_col``, the main text of every row's whole page; nothing shuffles and no row is dropped.

    Blocks that the field decodes as main are joined by an empty line in page order, each with its
    character references decoded and its white space collapsed. A null or empty page, or one without
    main blocks, has an empty text. Rows are judged one by one, so repeated rows get the same text.
    A column named ``text_col`` is replaced; other columns stay.
    """
    held = pages.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        extractor = Extractor(held.value)
        for batch in batches:
            yield pd.Series([extractor.main_text(p) for p in batch], dtype=object)

    kept = [c for c in pages.columns if c.lower() != text_col.lower()]
    return pages.select(*kept, extract(pages[html_col]).alias(text_col))


_trained: list[Field] = []


def trained_field() -> Field:
    """The field of :func:`training_pages`, trained once per driver process."""
    if not _trained:
        _trained.append(train_field(training_pages()))
    return _trained[0]


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extract_main_text(pages, trained_field())
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
