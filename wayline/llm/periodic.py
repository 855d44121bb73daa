"""Periodic runs of words, by Crochemore's refinement of the classes of equal factors.

Two places of a text are in one class of length k if the k words from them on are equal. Neighbours of a
class that are k apart begin a square of period k, and squares at places in a row make a run. From length
k to k + 1 only classes that are not the largest part of the class they came from split others, so every
place is moved a logarithmic number of times.

A run of exponent four has three places of one class at least in every length up to its period; smaller
classes are dropped at once. After a few lengths, which are refined for all texts of a block together by
sorting, hardly a place of ordinary prose is left, and what is left is refined text by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

#: A run is at least so many words long, and so many times its period.
SHORTEST, EXPONENT = 6, 4
#: Lengths refined for a whole block at once.
TOGETHER = 6
#: Bytes of texts that make a block.
BLOCK = 2_000_000

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


class Classes:
    """The classes of one text's places for one length, each an ascending linked list, and the gaps between neighbours."""

    def __init__(self, places: list[int], labels: list[int], length: int, fewest: int):
        self.length, self.fewest = length, fewest
        members: dict[int, list[int]] = {}
        self.of = dict(zip(places, labels))
        for p, c in self.of.items():
            members.setdefault(c, []).append(p)
        self.before: dict[int, int] = {}
        self.after: dict[int, int] = {}
        self.head = {c: m[0] for c, m in members.items()}
        self.size = {c: len(m) for c, m in members.items()}
        self.gaps: dict[int, list[int]] = {}
        self.next_label = max(members, default=0) + 1
        for m in members.values():
            self._chain(m)
        largest = max(members, key=self.size.get, default=None)
        self.small = [m for c, m in members.items() if c != largest]
        self.dead = [p + 1 for p in places if p + 1 not in self.of]

    def _chain(self, members: list[int]) -> None:
        for a, b in zip(members, members[1:]):
            self.after[a], self.before[b] = b, a
            if b - a > self.length:
                self.gaps.setdefault(b - a, []).append(a)

    def _unlink(self, p: int, label: int) -> None:
        a, b = self.before.pop(p, None), self.after.pop(p, None)
        if a is None:
            self.head[label] = b
        elif b is None:
            del self.after[a]
        else:
            self.after[a] = b
            if b - a > self.length:
                self.gaps.setdefault(b - a, []).append(a)
        if b is not None:
            if a is None:
                del self.before[b]
            else:
                self.before[b] = a
        self.size[label] -= 1

    def _remainder(self, label: int) -> list[int]:
        out, p = [], self.head[label]
        while p is not None:
            out.append(p)
            p = self.after.get(p)
        return out

    def squares(self) -> list[int]:
        """The places where a square begins whose period is the length."""
        k, after = self.length, self.after
        return [p for p in set(self.gaps.pop(k, ())) if after.get(p) == p + k]

    def refine(self) -> None:
        """On to the next length."""
        of, touched = self.of, {}
        for p in self.dead:
            if (c := of.get(p - 1)) is not None:
                touched.setdefault(c, {}).setdefault(-1, []).append(p - 1)
        for k, members in enumerate(self.small):
            for q in members:
                if (c := of.get(q - 1)) is not None:
                    touched.setdefault(c, {}).setdefault(k, []).append(q - 1)
        self.length += 1
        self.small, self.dead = [], []
        for c, parts in touched.items():
            gone = parts.pop(-1, [])
            for p in gone:
                self._unlink(p, c)
                del of[p]
            self.dead += gone
            rest = self.size[c] - sum(map(len, parts.values()))
            largest = max(parts.values(), key=len, default=[])
            stays = None if rest >= len(largest) else largest
            if not rest and len(parts) == 1:  # all of it goes on together
                parts, stays, rest = {}, None, self.size[c]
                largest = []
            for members in parts.values():
                for p in members:
                    self._unlink(p, c)
                if len(members) < self.fewest:
                    for p in members:
                        del of[p]
                    self.dead += members
                    continue
                label = self.next_label
                self.next_label += 1
                self.head[label], self.size[label] = members[0], len(members)
                for p in members:
                    of[p] = label
                self._chain(members)
                if members is not stays:
                    self.small.append(members)
            if rest < self.fewest:
                members = self._remainder(c)
                for p in members:
                    self._unlink(p, c)
                    del of[p]
                self.dead += members
            elif stays is not None and rest:
                self.small.append(self._remainder(c))
            if not self.size[c]:
                del self.size[c], self.head[c]


def runs_of(codes: np.ndarray, ends: np.ndarray, exponent: int = EXPONENT, shortest: int = SHORTEST) -> np.ndarray:
    """(start, length, period) of every run, by start and period, of texts whose words' codes follow each other.

    ``ends`` has each text's end; starts count from the first text's begin.
    """
    n = len(codes)
    none = np.zeros((0, 3), np.int64)
    if n < shortest:
        return none
    fewest = exponent - 1
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    at = np.arange(n)
    label = np.full(n + 1, -1, np.int64)  # of each place, -1 once it is dropped
    key = text * (int(codes.max()) + 1) + codes
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for length in range(1, TOGETHER + 1):
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        many = count[inverse] >= fewest
        label[at] = -1
        at, inverse = at[many], inverse[many]
        label[at] = inverse
        order = np.argsort(inverse, kind="stable")
        p, c = at[order], inverse[order]
        square = p[:-1][(c[1:] == c[:-1]) & (p[1:] - p[:-1] == length)]
        found.append((np.full(len(square), length), square))
        go = label[at + 1] >= 0
        go &= text[np.minimum(at + 1, n - 1)] == text[at]
        if length == TOGETHER or not len(at):
            break
        label_next = label[at[go] + 1]
        drop, at = at[~go], at[go]
        key = label[at] * (len(count) + 1) + label_next
        label[drop] = -1
    if len(at):
        cuts = np.flatnonzero(np.diff(text[at])) + 1
        first = np.concatenate([[0], ends])
        for places in np.split(at, cuts):
            t = int(text[places[0]])
            longest = int(ends[t] - first[t]) // exponent
            if longest <= TOGETHER:
                continue
            classes = Classes(places.tolist(), label[places].tolist(), TOGETHER, fewest)
            while classes.of and classes.length < longest:
                classes.refine()
                if squares := classes.squares():
                    found.append((np.full(len(squares), classes.length), np.array(squares)))
    period, place = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    if not len(place):
        return none
    order = np.lexsort((place, period))
    period, place = period[order], place[order]
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (np.diff(period) != 0)]))
    size = np.diff(np.append(begin, len(place)))
    start, q = place[begin], period[begin]
    length = size - 1 + 2 * q
    keep = length >= np.maximum(shortest, exponent * q)
    out = np.stack([start, length, q], 1)[keep]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, and each text's end among them; words are cut at ASCII white space, null counts as empty."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = split.offsets.to_numpy()
    flat = split.values.slice(offsets[0], offsets[-1] - offsets[0])
    some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(some)])
    return flat.filter(pa.array(some)), before[offsets[1:] - offsets[0]]


def _collapse(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The number of words, the runs and the text without repeats of each text."""
    words, ends = words_of(texts)
    n = len(ends)
    runs = runs_of(words.dictionary_encode().indices.to_numpy().astype(np.int64), ends) if len(words) else np.zeros((0, 3), np.int64)
    text = np.searchsorted(ends, runs[:, 0], side="right")
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(kept)])
    begins = np.concatenate([[0], ends[:-1]]) if n else ends
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], left[ends]]), pa.int64()), words.filter(pa.array(kept)))
    structs = pa.StructArray.from_arrays([pa.array(runs[:, 0] - begins[text] if len(runs) else runs[:, 0]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], names=["start", "length", "period"])
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]), pa.int32()), structs)
    return pa.array(ends - begins, pa.int64()), spans, pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` and ``collapsed``; nothing shuffles and no row is dropped.

    A run is a stretch of words with a smallest period q, as long as max(6, 4 q) at least, that no neighbouring word
    extends. ``runs`` are (start, length, period) by start and period; ``collapsed`` are the words that no run repeats
    after its first period, joined by one space. Words are cut at ASCII white space and compared byte by byte. A null
    or empty text has no words, no runs and an empty ``collapsed``. Repeated rows, other columns and empty tables pass
    through; columns of the added names are replaced. Long texts cost n log n.
    """
    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    kept = [c for c in docs.columns if c.lower() not in {f.name for f in added}]
    base = docs.select(*[docs[f"`{c}`"] for c in kept], docs[f"`{text_col}`"].alias("__source"))
    schema = T.StructType([*base.schema.fields[:-1], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * BLOCK // max(1, batch.column(batch.num_columns - 1).nbytes))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *_collapse(part.column(part.num_columns - 1))], names=schema.names)

    return base.mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run of the greatest exponent, compared exactly; ties go to the smallest start, then period."""
    first = F.lit(None).cast(RUNS.elementType)
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, first, lambda best, r: F.when(better(best, r), r).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; by its id's checksum every tenth text repeats a stretch of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"))
    sized = chosen.withColumn("n", F.size("words").cast("long")).withColumn("g", F.expr("h div 10"))
    begin = sized.withColumn("a", F.expr("g % nullif(n, 0)"))
    cycle = begin.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("slice(flatten(array_repeat(slice(words, int(a) + 1, int(p)), int((n - a + p - 1) div p))), 1, int(n - a))")
    return cycle.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(F.concat(F.expr("slice(words, 1, int(a))"), tail), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(planted(read(spark, sf_dir, "documents"))).drop("text").withColumn("best", strongest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        digest(listed).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
