"""N-gram Jaccard join by PartEnum signatures.

Sets of about equal size whose similarity is high enough differ in few features. The feature domain
is cut into partitions, and each partition into ``PARTS`` parts; a signature is the content of a subset
of ``PARTS - LOSE`` parts of one partition. Few differences leave some partition with ``LOSE`` of them at
most, so similar sets share a signature. Each band of sizes has its own number of partitions; a set
takes part in the join of its own band, and of the band below if that reaches it.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, drop, read, stored
from .graph import connected_components, smallest_reachable
from .words import arrow_blocks, constants, mix, part_of, word_hashes

PERCENT, WIDTH = 75, 5
#: Sets that share a signature are compared in pairs up to this many; see :func:`jaccard_classes` for larger groups.
BUCKET = 16
#: Parts of a partition, and how many of them a signature leaves out.
PARTS, LOSE = 3, 1
#: Nodes, and shingles of them all, of a block that needs its crowded signatures; a task compares two blocks.
CROWD_ROWS, CROWD_SHINGLES = 512, 1_000_000
#: Bytes of text that a task turns to signatures at once.
BLOCK_BYTES = 3_000_000
#: Signatures that one task groups.
SHARD_ENTRIES = 450_000

_U = np.uint64
_KEY = _U(0xD6E8FEB86659FD93)
_CROWDED = 65_535


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes, one text after the other, and their numbers.

    A text of fewer words has its whole sequence as its only shingle, a text without words none.
    """
    words, counts = word_hashes(texts)
    multipliers = constants(width, 3)
    ends = np.cumsum(counts)
    n = len(words) - width + 1
    sums = np.zeros(max(0, n), _U)
    for i in range(width if n > 0 else 0):
        sums += words[i : i + n] * multipliers[i]
    shingles = mix(sums)
    sets = []
    for end, count in zip(ends.tolist(), counts.tolist()):
        if count >= width:
            sets.append(np.unique(shingles[end - count : end - width + 1]))
        elif count:
            short = (words[end - count : end] * multipliers[:count]).sum(dtype=_U)
            sets.append(mix(np.array([short]) + np.array([count], _U) * _KEY))
        else:
            sets.append(np.zeros(0, _U))
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, _U)), sizes


class Bands:
    """Bands of set sizes; how much a set may differ from a partner; how many partitions the domain has."""

    def __init__(self, percent: int, largest: int, parts: int = PARTS, lose: int = LOSE):
        self.percent, self.parts, self.lose = percent, parts, lose
        low, high = [1], [1]
        while high[-1] < largest:
            low.append(high[-1] + 1)
            high.append(max(low[-1], low[-1] * 8 // 5, low[-1] * 100 // percent))
        self.low, self.high = np.array(low), np.array(high)
        # the fewest that are certain of a shared signature, and a tenth more, so that similar sets share several
        self.partitions = self._differ(self.high, self.high * 100 // percent) * 11 // (10 * (lose + 1)) + 2

    def _differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The largest symmetric difference of sets of sizes a and b that are similar enough."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def roles(self, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(takes part, band, largest difference from a partner there) in the set's own band and in the band below."""
        own = np.maximum(0, np.searchsorted(self.low, sizes, side="right") - 1)
        below = np.maximum(0, own - 1)
        reaches = (own > 0) & (-(-sizes * self.percent // 100) <= self.high[below])
        return [(sizes > 0, own, self._differ(sizes, sizes * 100 // self.percent)), (reaches, below, self._differ(sizes, self.high[below]))]

    def losses(self) -> list[tuple[int, int]]:
        """(signatures lost, non-empty parts) by one more difference in a partition, the worst first.

        With m non-empty parts and d differences in as many parts, the subsets without those parts
        are left, less the ones of empty parts only. Later differences in a partition never lose more
        than earlier ones, so taking the worst first is the worst case.
        """
        keep = self.parts - self.lose
        left = lambda m, d: math.comb(self.parts - d, keep) - math.comb(self.parts - max(m, d), keep) if d <= self.parts else 0
        steps = []
        for m in range(1, self.parts + 1):
            lost = [left(m, d) - left(m, d + 1) for d in range(self.lose + 1)]
            steps += [(max(lost[d:]), m) for d in range(self.lose + 1)]
        return sorted(steps, reverse=True)


def signatures(features: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set, role) of every subset of parts that is not empty, and the slack of each set in each role.

    The slack is the least number of a set's signatures that a similar partner shares: all of them
    less what the largest difference can lose. Without slack, a set also takes each feature as a
    signature.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    mixed = mix(features ^ _KEY)
    subsets = list(itertools.combinations(range(bands.parts), bands.parts - bands.lose))
    out, slacks = [], np.full((2, len(sizes)), 1 << 40, np.int64)
    for role, (takes, band, differ) in enumerate(bands.roles(sizes)):
        rows = np.flatnonzero(takes[owner])
        if not len(rows):
            continue
        who, f = owner[rows], features[rows]
        parts = bands.partitions[band].astype(_U)[who] * _U(bands.parts)
        part = ((f >> _U(32)) * parts) >> _U(32)
        first = np.ones(len(rows), bool)
        first[1:] = (who[1:] != who[:-1]) | (part[1:] != part[:-1])
        start = np.flatnonzero(first)
        sums, who, part = np.add.reduceat(mixed[rows], start), who[start], part[start]
        partition = part // _U(bands.parts)
        first = np.ones(len(start), bool)
        first[1:] = (who[1:] != who[:-1]) | (partition[1:] != partition[:-1])
        row = np.cumsum(first) - 1
        cell = row, (part % _U(bands.parts)).astype(np.int64)
        content, there = np.zeros((int(row[-1]) + 1, bands.parts), _U), np.zeros((int(row[-1]) + 1, bands.parts), bool)
        content[cell], there[cell] = sums, True
        who, partition = who[first], partition[first]
        tag = band.astype(_U)[who] * _KEY
        emitted = np.zeros(len(sizes), np.int64)
        for k, subset in enumerate(subsets):
            some = there[:, subset].any(axis=1)
            label = mix((partition * _U(len(subsets)) + _U(k))[some] + tag[some])
            out.append((mix(content[:, subset].sum(axis=1, dtype=_U)[some] + label), who[some], role))
            emitted += np.bincount(who[some], minlength=len(sizes))
        filled = there.sum(axis=1)
        rest = np.where(takes, differ, 0)
        worst = emitted
        of = {m: np.bincount(who[filled == m], minlength=len(sizes)) for m in range(1, bands.parts + 1)}
        for lost, m in bands.losses():
            hit = np.minimum(rest, of[m])
            worst, rest = worst - lost * hit, rest - hit
        slacks[role] = np.where(takes, worst, slacks[role])
        short = (slacks[role] <= 0)[owner[rows]]
        if short.any():
            who = owner[rows][short]
            out.append((mix(mixed[rows][short] + mix(band.astype(_U)[who] * _KEY + _U(1)) + _U(5)), who, role))
    if not out:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), slacks
    return np.concatenate([s for s, _, _ in out]), np.concatenate([w for _, w, _ in out]), np.concatenate([np.full(len(w), r) for _, w, r in out]), slacks


def set_identity(features: np.ndarray, sizes: np.ndarray, node_bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each whole set: the node, and the check that tells sets of one node apart."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for key in constants(2, 9):
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(features + key))])
        out.append(mix(sums[ends[1:]] - sums[ends[:-1]] + sizes.astype(_U)))
    return (out[0] >> _U(64 - node_bits)).view(np.int64), out[1].view(np.int64)


#: Rows of the join's one exchange. kind 0 holds packed signatures; 1 crowded signatures (signature, node,
#: role); 2 documents (id, set size, node, check, slacks, band); 3 pairs of nodes with the number of shared signatures.
_LONGS = T.ArrayType(T.LongType())
_ROWS = T.StructType([T.StructField("shard", T.LongType()), T.StructField("kind", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in ("low", "who", "nodes")), *(T.StructField(n, _LONGS) for n in "pqrsuvw")])


def _rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"shard": pa.int64(), "kind": pa.int32(), **{n: pa.binary() for n in ("low", "who", "nodes")}, **{n: pa.list_(pa.int64()) for n in "pqrsuvw"}}
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in kinds.items()], names=list(kinds))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(values)))


def _emit(ids: list[int | None], texts: list[str | None], percent: int, width: int, bits: int, bucket: int, shape: tuple[int, int], node_bits: int) -> list[dict]:
    """The rows of one block of texts. Signatures are cut to ``bits`` + 32 bits: the shard and four bytes."""
    features, sizes = shingle_sets(texts, width)
    node, check = set_identity(features, sizes, node_bits)
    order = np.lexsort((check, node))
    new = np.ones(len(node), bool)
    new[1:] = (node[order][1:] != node[order][:-1]) | (check[order][1:] != check[order][:-1])
    first, place = order[new], np.empty(len(node), np.int64)
    place[order] = np.cumsum(new) - 1
    nodes = node[first]  # equal sets speak once
    ends = np.cumsum(sizes)
    mine = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in first]) if len(first) else np.zeros(0, np.int64)
    bands = Bands(percent, int(sizes.max(initial=1)), *shape)
    sig, who, role, slack = signatures(features[mine], sizes[first], bands)
    slacks = slack[:, place]
    shard_of_rest = -1 - (int(node[0]) & ((1 << bits) - 1)) if len(node) else -1
    rows = [{"shard": shard_of_rest, "kind": 2, "p": ids, "q": sizes, "r": node, "s": check, "u": slacks[0], "v": slacks[1], "w": bands.roles(sizes)[0][1]}]
    if not len(sig):
        return rows
    cut = sig >> _U(32 - bits)
    order = np.argsort(cut, kind="stable")
    cut, who, role = cut[order], who[order], role[order]
    starts, lengths = _runs(cut)
    crowded = np.repeat(lengths > bucket, lengths)
    if crowded.any():
        rows.append({"shard": shard_of_rest, "kind": 1, "p": cut[crowded].view(np.int64), "q": nodes[who[crowded]], "r": role[crowded]})
    packed = (who * 2 + role).astype(np.uint16)
    packed[starts[lengths > bucket]] = _CROWDED
    stay = ~crowded
    stay[starts] = True
    cut, packed = cut[stay], packed[stay]
    shard = (cut >> _U(32)).astype(np.int64)
    for start, length in zip(*_runs(shard)):
        part = slice(start, start + length)
        local, which = np.unique(packed[part] >> 1, return_inverse=True)
        marks = packed[part] == _CROWDED
        mine16 = np.where(marks, _CROWDED, which * 2 + (packed[part] & 1)).astype(np.uint16)
        rows.append({"shard": int(shard[start]), "kind": 0, "low": cut[part].astype(np.uint32).tobytes(), "who": mine16.tobytes(), "nodes": nodes[np.minimum(local, len(nodes) - 1)].tobytes()})
    return rows


def _group(table: pa.Table, bucket: int) -> pa.Table:
    """Pairs of nodes that share a signature, and the members of crowded signatures; other rows pass."""
    table = table.combine_chunks()
    kinds = table.column("kind").to_numpy()
    if (kinds != 0).any():
        return table
    shard = table.column("shard")[0].as_py()
    sig, packed, node = [], [], []
    for r in range(table.num_rows):
        p = np.frombuffer(table.column("who")[r].as_py(), np.uint16)
        of = np.frombuffer(table.column("nodes")[r].as_py(), np.int64)
        sig.append(np.frombuffer(table.column("low")[r].as_py(), np.uint32))
        packed.append(p)
        node.append(of[np.minimum(p >> 1, len(of) - 1)])
    sig, packed, node = (np.concatenate(x) for x in (sig, packed, node))
    order = np.argsort(sig, kind="stable")
    _, lengths = _runs(sig[order])
    order = order[np.repeat(lengths > 1, lengths)]
    sig, packed, node = sig[order].astype(np.int64), packed[order], node[order]
    mark = packed == _CROWDED
    order = np.lexsort((node, mark, sig))
    sig, packed, node, mark = sig[order], packed[order], node[order], mark[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]) | (mark[1:] != mark[:-1])
    sig, packed, node, mark = sig[new], packed[new], node[new], mark[new]
    starts, lengths = _runs(sig)
    marked = np.maximum.reduceat(mark, starts) if len(starts) else np.zeros(0, bool)
    crowded = np.repeat((lengths > bucket) | marked, lengths)
    over = crowded & ~mark
    out = [{"shard": shard, "kind": 1, "p": sig[over] | np.int64(shard) << 32, "q": node[over], "r": (packed[over] & 1).astype(np.int64)}]
    sig, node = sig[~crowded], node[~crowded]
    some, place = np.unique(node, return_inverse=True)
    pairs = [np.zeros(0, np.int64)]
    for step in range(1, bucket):
        same = np.flatnonzero(sig[step:] == sig[:-step])
        if not len(same):
            break
        pairs.append(place[same] * len(some) + place[same + step])  # nodes of a signature are in order
    both, often = np.unique(np.concatenate(pairs), return_counts=True)
    out.append({"shard": shard, "kind": 3, "p": some[both // max(1, len(some))], "q": some[both % max(1, len(some))], "r": often})
    return pa.Table.from_batches([_rows(out)])


def _exploded(found: DataFrame, kind: int, **names: str) -> DataFrame:
    zipped = F.arrays_zip(*[F.col(c).alias(c) for c in names])
    return found.where(F.col("kind") == kind).select(F.explode(zipped).alias("z")).select(*[F.col(f"z.{c}").alias(n) for c, n in names.items()])


def _candidates(pairs: DataFrame, limits: DataFrame, percent: int) -> DataFrame:
    """The pairs (sets named by _a and _b) that share as many uncrowded signatures as similar sets must, and whose sizes allow it.

    The band of the smaller sizes decides: there both sets share their slack less what is crowded.
    Sets of one node have not met and are all candidates.
    """
    side = lambda df, n: df.select(*[F.col(c).alias(f"{c}_{n}") for c in ("node", "check", "rep", "size", "band", "need_0", "need_1")])
    summed = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    both = summed.join(side(limits, "a"), F.col("a") == F.col("node_a")).join(side(limits, "b"), F.col("b") == F.col("node_b"))
    apart = F.col("band_b") - F.col("band_a")
    need = F.when(apart == 0, F.greatest("need_0_a", "need_0_b")).when(apart == 1, F.greatest("need_0_a", "need_1_b")).when(apart == -1, F.greatest("need_1_a", "need_0_b"))
    near = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent
    twins = limits.join(limits.groupBy("node").count().where("count > 1").select("node"), "node", "left_semi")
    twins = side(twins, "a").join(side(twins, "b"), (F.col("node_a") == F.col("node_b")) & (F.col("check_a") < F.col("check_b")))
    names = [f"{c}_{n}" for n in "ab" for c in ("node", "check", "rep")]
    return both.where(near & (F.col("n") >= need)).select(*names).unionByName(twins.where(near).select(*names))


def _texts(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, check, text) of the documents that stand for ``sets`` (node, check, rep)."""
    wanted = stored(sets.select("node", "check", "rep").distinct())
    out = stored(docs.join(broadcast_if_small(wanted, wanted.count()), F.col("doc_id") == F.col("rep")).select("node", "check", "text"))
    drop(wanted)
    return out


def _linked(pairs: DataFrame, docs: DataFrame, percent: int, width: int, node_bits: int) -> DataFrame:
    """The pairs (rep_a, rep_b) of documents whose sets, made anew from the whole texts, are similar enough."""
    pairs = stored(pairs)
    ends = lambda n: pairs.select(*[F.col(f"{c}_{n}").alias(c) for c in ("node", "check", "rep")])
    texts = _texts(ends("a").unionByName(ends("b")), docs)
    links = _verified(pairs, texts, percent, width, node_bits)
    drop(pairs, texts)
    return links


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, width: int, node_bits: int) -> DataFrame:
    """The pairs of :func:`_linked`, with the texts (node, check, text) at hand."""
    side = lambda n: texts.toDF(f"node_{n}", f"check_{n}", f"text_{n}")
    both = pairs.join(side("b"), ["node_b", "check_b"]).join(side("a"), ["node_a", "check_a"])
    both = both.select("rep_a", "rep_b", "node_a", "check_a", "node_b", "check_b", "text_a", "text_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[tuple, str, np.ndarray | None] = ((), "", None)
        for batch in batches:
            links: list[tuple[int, int]] = []
            for r in range(batch.num_rows):
                rep_a, rep_b, *named, x, y = (c[r].as_py() for c in batch.columns)
                a, b = tuple(named[:2]), tuple(named[2:])
                if held[2] is None or held[0] != a or held[1] != x:
                    held = (a, x, _set_of(a, x, width, node_bits))
                other = _set_of(b, y, width, node_bits)
                if held[2] is None or other is None:
                    continue
                shared = len(np.intersect1d(held[2], other, assume_unique=True))
                if 100 * shared >= percent * (len(held[2]) + len(other) - shared):
                    links.append((rep_a, rep_b))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in links], pa.int64()), pa.array([k for _, k in links], pa.int64())], names=["rep_a", "rep_b"])

    return stored(both.mapInArrow(verify, "rep_a long, rep_b long").distinct())


def _set_of(node: tuple[int, int], text: str | None, width: int, node_bits: int) -> np.ndarray | None:
    """The set of ``text`` if it is the node's; an id may also stand for other texts."""
    features, sizes = shingle_sets([text], width)
    own, check = set_identity(features, sizes, node_bits)
    return features if (own[0], check[0]) == node else None


def _sets_of(table: pa.Table, width: int, node_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The set of each row (node, check, text), and whether it is the first one of its name; an id may also stand for other texts."""
    node, check = table.column("node").to_numpy(), table.column("check").to_numpy()
    features, sizes = shingle_sets(table.column("text").to_pylist(), width)
    own, other = set_identity(features, sizes, node_bits)
    mine = (own == node) & (other == check)
    order = np.lexsort((~mine, check, node))
    same = (node[order][1:] == node[order][:-1]) & (check[order][1:] == check[order][:-1])
    mine[order[1:][same]] = False
    ends = np.cumsum(sizes)
    return [features[e - n : e] for n, e in zip(sizes, ends)], mine


def _similar(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of ``left`` are similar to which of ``right``: shared features are counted by matrix products."""
    sets = [*left, *right]
    _, local, often = np.unique(np.concatenate(sets) if sets else np.zeros(0, _U), return_inverse=True, return_counts=True)
    column = np.cumsum(often > 1) - 1
    ends = np.cumsum([0, *map(len, sets)])
    use = [local[i:j] for i, j in zip(ends, ends[1:])]
    use = [column[u[often[u] > 1]] for u in use]
    shared = np.zeros((len(left), len(right)))
    wide = int((often > 1).sum())
    for start in range(0, wide, 8192):
        grid = np.zeros((len(sets), min(8192, wide - start)), np.float32)
        for r, u in enumerate(use):
            grid[r, u[np.searchsorted(u, start) : np.searchsorted(u, start + 8192)] - start] = 1
        shared += grid[: len(left)] @ grid[len(left) :].T
    sizes = np.array([*map(len, sets)])
    union = sizes[: len(left), None] + sizes[None, len(left) :] - shared
    return 100 * shared >= percent * union


def _crowd_links(over: DataFrame, limits: DataFrame, docs: DataFrame, percent: int, width: int, crowd_rows: int, node_bits: int) -> DataFrame:
    """Links (rep_a, rep_b) that join the same sets as all links between nodes that need their crowded signatures.

    ``over`` has the members (sig, node, role) of the crowded signatures. The nodes fall into
    families, connected by crowded signatures, and a family into bands of set size. First every set
    of a band is compared with the band's leader, and leaders with those of the next band. Sets that
    are linked to their leader need no comparison with each other, nor with those of the next band if
    the leaders are linked. All other pairs of a band and the next are compared in blocks of about
    ``crowd_rows`` sets and ``CROWD_SHINGLES`` shingles, by a task for two blocks that returns at most
    one link a set. So a family around its leaders costs one comparison a set.
    """
    need = F.when(F.col("role") == 0, F.col("need_0")).otherwise(F.col("need_1"))
    members = stored(over.join(limits.where("need_0 <= 0 OR need_1 <= 0"), "node").where(need <= 0).select("sig", "node"))
    pivots = stored(members.groupBy("sig").agg(F.min("node").alias("pivot")))
    family = connected_components(members.join(pivots, "sig").select("node", "pivot"), "node", "pivot")
    some = members.select("node").distinct().join(family, "node", "left").select("node", F.coalesce("component", "node").alias("family"))
    placed = stored(some.join(limits.select("node", "check", "rep", "band", "size"), "node"))
    texts = _texts(placed, docs)
    blocks = F.greatest(F.ceil(F.count("*") / crowd_rows), F.ceil(F.sum("size") / CROWD_SHINGLES)).cast("int")
    name = ["node", "check", "rep"]

    bands = stored(placed.groupBy("family", "band").agg(F.min(F.struct(*name)).alias("leader"), blocks.alias("blocks")))
    leaders = bands.select("family", "band", "leader.*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("leads"))
    dealt = placed.join(bands, ["family", "band"]).where(F.struct(*name) != F.col("leader"))
    dealt = dealt.select("family", "band", *name, F.pmod(F.xxhash64("node", "check"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("leads"))
    led = dealt.unionByName(leaders).join(texts, ["node", "check"])

    def follow(table: pa.Table) -> pa.Table:
        sets, mine = _sets_of(table, width, node_bits)
        leads = table.column("leads").to_numpy()
        inner = leads.copy()
        first, rest = np.flatnonzero(leads & mine), np.flatnonzero(~leads & mine)
        if len(first) and len(rest):
            inner[rest] = _similar([sets[i] for i in rest], [sets[first[0]]], percent)[:, 0]
        return table.select(["family", "band", *name]).append_column("inner", pa.array(inner.astype(np.int32)))

    judged = stored(led.groupBy("family", "band", "block").applyInArrow(follow, "family long, band long, node long, check long, rep long, inner int").distinct())
    to_leader = judged.where("inner = 1").join(bands.select("family", "band", F.col("leader.rep").alias("rep_a")), ["family", "band"]).select("rep_a", F.col("rep").alias("rep_b")).where("rep_a <> rep_b")
    side = lambda n, up: bands.select("family", (F.col("band") - up).alias("band"), *[F.col(f"leader.{c}").alias(f"{c}_{n}") for c in name])
    steps = stored(side("a", 0).join(side("b", 1), ["family", "band"]))
    between = _verified(steps, texts, percent, width, node_bits)
    linked = steps.join(between.withColumn("up", F.lit(True)), ["rep_a", "rep_b"], "left").select("family", "band", F.coalesce("up", F.lit(False)).alias("up"))

    kind = F.col("band") * 2 + F.col("inner")
    counts = judged.join(placed.select("node", "check", "size"), ["node", "check"]).groupBy("family", kind.alias("kind")).agg(blocks.alias("blocks"))
    known = counts.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("kind", "blocks"))).alias("blocks"))
    ups = linked.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("band", "up"))).alias("ups"))
    maps = stored(known.join(ups, "family", "left"))
    held = judged.join(maps, "family")
    own = F.struct(kind.alias("kind"), F.pmod(F.xxhash64("node", "check"), F.col("blocks")[kind]).cast("int").alias("block"))
    up = lambda band: F.coalesce(F.try_element_at("ups", band), F.lit(False))

    def partners(by: int, inner: int) -> Column:
        other = (F.col("band") + by) * 2 + inner
        n = F.coalesce(F.try_element_at("blocks", other), F.lit(0))
        known = F.lit(True) if by == 0 else up(F.col("band") + min(by, 0))
        skip = (F.col("inner") == 1) & known if inner else F.lit(False)
        task = lambda j: F.struct(F.least(own, F.struct(other.alias("kind"), j.alias("block"))).alias("low"), F.greatest(own, F.struct(other.alias("kind"), j.alias("block"))).alias("high"))
        return F.when(~skip & (n > 0), F.transform(F.sequence(F.lit(0), n - 1), task)).otherwise(F.array())

    tasks = F.concat(*[partners(by, inner) for by in (-1, 0, 1) for inner in (0, 1)])
    spread = held.select(*name, "family", own.alias("own"), F.explode(tasks).alias("z"))
    spread = stored(spread.select(*name, "family", "z.low", "z.high", (F.col("own") == F.col("z.high")).alias("second")))
    full = spread.join(texts, ["node", "check"])

    def compare(table: pa.Table) -> pa.Table:
        rep, second = table.column("rep").to_numpy(), table.column("second").to_numpy()
        within = table.column("low")[0].as_py() == table.column("high")[0].as_py()
        sets, mine = _sets_of(table, width, node_bits)
        left, right = (np.flatnonzero(mine & (True if within else second == s)) for s in (False, True))
        i, j = np.nonzero(_similar([sets[k] for k in left], [sets[k] for k in right], percent))
        apart = left[i] != right[j]
        root = smallest_reachable(len(rep), [(left[i[apart]], right[j[apart]])])
        moved = np.flatnonzero(root != np.arange(len(rep)))
        return pa.table({"rep_a": pa.array(rep[root[moved]]), "rep_b": pa.array(rep[moved])})

    met = full.groupBy("family", "low", "high").applyInArrow(compare, "rep_a long, rep_b long")
    links = stored(met.unionByName(to_leader).unionByName(between))
    drop(members, pivots, family, placed, texts, bands, judged, steps, between, maps, spread)
    return links


def jaccard_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = PERCENT,
    width: int = WIDTH,
    bucket: int = BUCKET,
    shard_entries: int = SHARD_ENTRIES,
    crowd_rows: int = CROWD_ROWS,
    parts: int = PARTS,
    lose: int = LOSE,
    node_bits: int = 64,
) -> DataFrame:
    """(id, ``n_shingles``, ``component_id``) for every row of ``docs``.

    Words are runs of characters other than ASCII white space, with A-Z lower-cased; a text's set is
    its distinct shingles of ``width`` words. Two texts are linked when 100 * intersection >=
    percent * union; ``component_id`` is the smallest id reachable by links, itself included. A text
    of fewer words has one shingle, its whole sequence. A null or empty text, or one without words,
    has none and is linked with nothing. A row with a null id is returned with a null component and
    linked with nothing. Ids are integers; repeated rows are returned each time; an id of several
    texts joins their classes. An empty table gives no rows; other columns are not returned.

    Shingles are 64-bit hashes. A set is known by 128 bits, of which signatures carry ``node_bits``;
    sets that agree in those are told apart by the rest. Equal sets are one, however many rows have
    them. A signature is the content of ``parts - lose`` of the ``parts`` of a partition
    (:func:`signatures`). Nodes that share a signature meet,
    in all pairs while at most ``bucket`` share it; pairs that meet as often as similar sets must are
    candidates (:func:`_candidates`). A signature of more nodes is crowded:

    * A node whose slack exceeds its number of crowded signatures shares an uncrowded one with every
      similar partner, so its crowded ones are not needed.
    * The other nodes, which lie in large groups of near copies, are compared within the families
      that their crowded signatures form (:func:`_crowd_links`): with a leader, and what is not
      linked to it in blocks. Only a family that spreads far from its leaders costs the square of its
      size; no pair is emitted and no family meets in one task.

    Every candidate is verified on its whole texts. No group meets in one task: a block of texts
    sends a signature that is crowded within it as one mark, and its members apart, as plain rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, 0.17 * chars / shard_entries))))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for part in arrow_blocks(texts, BLOCK_BYTES):
                yield _rows(_emit(part_of(ids, part), part_of(texts, part), percent, width, bits, bucket, (parts, lose), node_bits))

    found = stored(base.mapInArrow(emit, _ROWS).groupBy("shard").applyInArrow(lambda t: _group(t, bucket), _ROWS))
    rows = stored(_exploded(found, 2, p="doc_id", q="n_shingles", r="node", s="check", u="slack_0", v="slack_1", w="band"))
    known = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = known.groupBy("node", "check").agg(F.min("doc_id").alias("rep"), F.min("slack_0").alias("slack_0"), F.min("slack_1").alias("slack_1"), F.min("band").alias("band"), F.min("n_shingles").alias("size"))
    over = stored(_exploded(found, 1, p="sig", q="node", r="role").distinct())
    crowds = over.groupBy("node").agg(*[F.count_if(F.col("role") == r).alias(f"crowded_{r}") for r in (0, 1)])
    need = lambda r: (F.col(f"slack_{r}") - F.coalesce(f"crowded_{r}", F.lit(0))).alias(f"need_{r}")
    limits = stored(sets.join(crowds, "node", "left").select("node", "check", "rep", "size", "band", need(0), need(1)))
    pairs = _linked(_candidates(_exploded(found, 3, p="a", q="b", r="n"), limits, percent), base, percent, width, node_bits)
    drop(found)
    crowd = _crowd_links(over, limits, base, percent, width, crowd_rows, node_bits)
    ids = known.select("doc_id", "node", "check")
    shared = ids.groupBy("doc_id").agg(F.min(F.struct("node", "check")).alias("x"), F.max(F.struct("node", "check")).alias("y")).where("x <> y").select("doc_id")
    same_id = ids.join(shared, "doc_id").join(limits, ["node", "check"]).select(F.col("doc_id").alias("rep_a"), F.col("rep").alias("rep_b"))
    links = stored(pairs.unionByName(crowd).unionByName(same_id))
    classes = connected_components(links, "rep_a", "rep_b")
    placed = stored(limits.select("node", "check", "rep").join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("node", "check", F.coalesce("component", "rep").alias("component")))
    drop(over, limits, pairs, crowd, links, classes)
    joined = rows.select("doc_id", "n_shingles", "node", "check").join(placed, ["node", "check"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return joined.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM d
), one AS (SELECT r, doc_id, len(s) AS n, unnest(s) AS shingle FROM sets WHERE doc_id IS NOT NULL),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b USING (shingle) WHERE a.r <> b.r
  GROUP BY a.doc_id, b.doc_id, a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), edges AS (SELECT DISTINCT a, b FROM links),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM d WHERE doc_id IS NOT NULL UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets LEFT JOIN component ON component.doc_id = sets.doc_id
"""
