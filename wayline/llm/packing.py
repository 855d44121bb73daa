"""Packing: length buckets that minimise padding, with token-budget batches inside each bucket."""

from __future__ import annotations

from array import array
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators.common import ranked

from .bpe import bpe_count, public_vocabulary
from .common import drop, read, stored

BUCKETS, TOKEN_BUDGET = 16, 65_536


def optimal_boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """The at most ``buckets`` upper bounds that minimise the padding of (length, count) pairs.

    With k buckets ending at length i, cost(k, i) = min over j of cost(k-1, j) + the padding of the
    lengths after j up to i. Each j is a line in the i-th length, so a convex hull of lines gives
    every minimum in linear time. It holds 8 bytes a bucket and length, and a few hundred a length.
    """
    pairs = sorted((n, c) for n, c in histogram if c)
    if not pairs:
        return []
    lengths = [n for n, _ in pairs]
    counts, sums = [0], [0]
    for n, c in pairs:
        counts.append(counts[-1] + c)
        sums.append(sums[-1] + n * c)
    m = len(pairs)
    cost = [0] + [lengths[i - 1] * counts[i] - sums[i] for i in range(1, m + 1)]
    chosen = [array("q", bytes(8 * (m + 1)))]
    for k in range(1, min(buckets, m)):
        lines: deque[tuple[int, int, int]] = deque()  # slope, intercept, j; slopes fall
        new, back = [0] * (m + 1), array("q", bytes(8 * (m + 1)))
        for i in range(1, m + 1):
            j = i - 1
            if j >= k:
                slope, at = -counts[j], cost[j] + sums[j]
                while len(lines) > 1 and (at - lines[-2][1]) * (lines[-2][0] - lines[-1][0]) <= (lines[-1][1] - lines[-2][1]) * (lines[-2][0] - slope):
                    lines.pop()
                lines.append((slope, at, j))
            x = lengths[i - 1]
            if not lines:
                new[i], back[i] = cost[i], chosen[-1][i]
                continue
            while len(lines) > 1 and lines[1][0] * x + lines[1][1] <= lines[0][0] * x + lines[0][1]:
                lines.popleft()
            new[i], back[i] = lines[0][0] * x + lines[0][1] + x * counts[i] - sums[i], lines[0][2]
        cost = new
        chosen.append(back)
    bounds, i = [], m
    for back in reversed(chosen):
        if i == 0:
            break
        bounds.append(lengths[i - 1])
        i = back[i]
    return sorted(set(bounds))


def length_histogram(lengths: DataFrame, column: str) -> list[tuple[int, int]]:
    """(length, count) over all rows, exact.

    D distinct lengths need D * (D - 1) / 2 tokens at least, so the driver holds at most about
    sqrt(2 * all tokens) of them: 100,000 for a corpus of 5e9 tokens.
    """
    counts = lengths.groupBy(F.col(column).alias("length")).agg(F.count("*").alias("n"))
    return [(int(r["length"]), int(r["n"])) for r in counts.collect()]


ADDED = ("n_tokens", "bucket", "bucket_length", "batch", "slot", "padding")


def pack(docs: DataFrame, length: Column, order: list[str], buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """All rows of ``docs`` with ``n_tokens``, ``bucket``, ``bucket_length``, ``batch``, ``slot`` and ``padding``.

    A bucket's rows are padded to ``bucket_length`` (at least 1); a batch of the bucket holds
    floor(token_budget / bucket_length) rows, and one row where that is 0, so a document over the
    budget is a batch of its own and is not cut. Rows are dealt to the batches of a bucket in the
    order of ``order``, ties in the order of ``docs``; only a bucket's last batch may have free slots.
    A null length counts as 0; empty documents are packed too. An empty table gives no rows. Repeated
    rows take a slot each. Columns of the added names in ``docs`` are replaced.

    ``docs`` is written once with its lengths, so keep it to the columns needed. Only the histogram
    reaches the driver, exact for any number of lengths. A bucket may hold any share of the rows, and
    any number of them may be equal: rows are numbered over all buckets by ranges of their order.
    """
    names = [c for c in docs.columns if c.lower() not in ADDED]
    base = stored(docs.select("*", F.coalesce(length, F.lit(0)).cast("long").alias("__n"), F.monotonically_increasing_id().alias("__tie")).select(*names, F.col("__n").alias("n_tokens"), "__tie"))
    histogram = length_histogram(base, "n_tokens")
    bounds = optimal_boundaries(histogram, buckets)
    if not bounds:
        return base.select(*names, "n_tokens", *[F.lit(0).cast(t).alias(n) for n, t in (("bucket", "int"), ("bucket_length", "long"), ("batch", "long"), ("slot", "long"), ("padding", "long"))])
    before = [sum(c for n, c in histogram if n <= low) for low in [-1, *bounds[:-1]]]
    sizes = [max(1, b) for b in bounds]
    rows = [max(1, token_budget // s) for s in sizes]
    of = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("bucket") + 1).cast("long")
    bucket = F.lit(0)
    for b in bounds[:-1]:
        bucket += (F.col("n_tokens") > b).cast("int")
    placed = ranked(base.withColumn("bucket", bucket), "bucket", *order, "__tie", name="__rank")
    drop(base)
    rank = F.col("__rank") - of(before)
    return placed.withColumn("bucket_length", of(sizes)).select(
        *names, "n_tokens", "bucket", "bucket_length",
        F.floor(rank / of(rows)).cast("long").alias("batch"), F.pmod(rank, of(rows)).cast("long").alias("slot"), (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
    )


def pack_documents(docs: DataFrame, vocabulary: str | None = None, **sizes: int) -> DataFrame:
    """Packs documents by their tokens under a byte-pair ``vocabulary`` (see ``bpe``), in the order of id; the texts do not move."""
    counted = bpe_count(docs.select("doc_id", "text"), vocabulary or public_vocabulary(), count_col="n_tokens").select("doc_id", "n_tokens")
    return pack(counted, F.col("n_tokens"), ["doc_id"], **sizes)


def token_batches(packed: DataFrame, ids_col: str = "ids", pad_id: int = 0) -> DataFrame:
    """(bucket, batch, bucket_length, rows, padded) of packed rows: one row per batch, its sequences in the order of slots.

    ``packed`` is a result of :func:`pack` with ``ids_col``, array<int>, of ``n_tokens`` ids each.
    ``rows`` holds the other columns and the number of ids of each sequence, ``padded`` the sequences
    with ``pad_id`` up to ``bucket_length``. A batch has at most the token budget, or one document.
    Null ids count as none.
    """
    names = [c for c in packed.columns if c not in (*ADDED, ids_col)]
    ids = F.coalesce(ids_col, F.array().cast("array<int>"))
    full = F.concat(ids, F.array_repeat(F.lit(pad_id), (F.col("bucket_length") - F.size(ids)).cast("int")))
    one = F.struct("slot", F.struct(*names, F.size(ids).alias("n_ids")).alias("row"), full.alias("padded"))
    held = packed.groupBy("bucket", "batch").agg(F.first("bucket_length").alias("bucket_length"), F.array_sort(F.collect_list(one)).alias("s"))
    return held.select("bucket", "batch", "bucket_length", F.col("s.row").alias("rows"), F.col("s.padded").alias("padded"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
