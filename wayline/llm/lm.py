"""LM scoring: a smoothed n-gram model as a weighted backoff automaton, one pass over each text that carries the state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .words import arrow_blocks, constants, mix, pack_counts, pack_keys, part_of, unpack_counts, unpack_keys, word_hashes

#: Tokens of the longest n-gram.
ORDER = 3
#: Weight of the shorter context's distribution, in observations; see README for the held-out comparison.
PRIOR = 128.0
#: A context of two tokens or more is a state if training has it so often.
MIN_CONTEXT = 1
#: Characters of text that one task scores against its own part of the model.
CHUNK_CHARS = 9_000_000
#: Distinct n-grams that one task counts, over all chunks.
SHARD_KEYS = 2_000_000
#: Tokens in a row that the traversal takes of one document at a time.
SEGMENT = 512

_BEGIN, _END = mix(np.array([11, 13], np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all texts, an end after each text, and the token counts."""
    h, counts = word_hashes(texts)
    return np.insert(h, np.cumsum(counts), _END), counts + 1


def some_place(place: np.ndarray, n: int) -> np.ndarray:
    """Of each of ``n`` grams a token at which it ends, from the gram or -1 of each token."""
    out = np.zeros(n + 1, np.int64)
    out[place] = np.arange(len(place))  # -1 is the last
    return out[:-1]


class Grams:
    """The n-grams that end in each token of a chunk, level by level, with their training counts.

    Of level k, ``keys`` are the distinct 64-bit keys in order, ``place`` is where each token's gram
    is among them, or -1, and ``totals`` are the counts once they are known. A begin stands before
    each text; a gram does not reach beyond it. The grams of level 3 and up are those whose context
    is a state. Two of 10^10 grams share a key with a chance of one in a few.

    A gram is ``shared`` if other chunks have it too and training has it at all. Of level 3 and up
    only grams whose first and last part are shared are asked for: of the others no other chunk has
    a training count, so their totals are the chunk's own.
    """

    def __init__(self, texts: list[str | None], learn: np.ndarray, min_context: int):
        self.tokens, self.counts = _tokens(texts)
        self.min_context = min_context
        first = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.nth = np.arange(len(self.tokens)) - first[self.doc]
        self.learn = learn[self.doc]
        self.begins = int(learn.sum())
        self.first = first
        keys, place = np.unique(self.tokens, return_inverse=True)
        self.keys, self.place, self.totals, self.shared, self.asked = [keys], [place], [], [], []
        self.begin_total = 0

    def before(self, values: np.ndarray, outside: int) -> np.ndarray:
        """The value of the token before each one, or ``outside`` for the first of a text."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = outside
        return out

    def context(self, k: int) -> np.ndarray:
        """Training count of the k tokens before each token: 0 where that is no state."""
        if k == 1:
            return self.before(self.totals[0][self.place[0]], self.begin_total)
        counts = np.where(self.place[k - 1] >= 0, self.totals[k - 1][self.place[k - 1]] if len(self.totals[k - 1]) else 0, 0)
        counts = self.before(counts, 0)
        return np.where(counts >= self.min_context, counts, 0)

    def grow(self) -> None:
        """Finds the grams of the next level; those below level 2 must have their totals."""
        k = len(self.keys) + 1
        there = self.nth >= k - 2
        if k > 2:
            there &= self.context(k - 1) > 0
        at = np.flatnonzero(there)
        sums = np.zeros(len(at), np.uint64)
        for j, m in enumerate(constants(k, k + 2)):
            back = np.where(self.nth[at] >= j, self.tokens[at - np.minimum(j, self.nth[at])], _BEGIN)
            sums += back * m
        keys, local = np.unique(mix(sums), return_inverse=True)
        place = np.full(len(self.tokens), -1)
        place[at] = local
        self.keys.append(keys)
        self.place.append(place)
        if k > 2:
            ends = some_place(place, len(keys))  # never a text's first token
            shared = self.shared[k - 2]
            self.asked.append(np.flatnonzero(shared[self.place[k - 2][ends]] & shared[self.place[k - 2][ends - 1]]))

    def learnt(self, k: int) -> np.ndarray:
        """Training counts of level k within the chunk."""
        place = self.place[k - 1][self.learn]
        return np.bincount(place[place >= 0], minlength=len(self.keys[k - 1]))

    def ask(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted keys whose totals are wanted next, and their counts in the chunk."""
        if self.totals:
            self.grow()
            return self.keys[-1][self.asked[-1]], self.learnt(len(self.keys))[self.asked[-1]]
        self.grow()
        keys = np.concatenate([self.keys[0], self.keys[1], np.array([_BEGIN])])
        counts = np.concatenate([self.learnt(1), self.learnt(2), [self.begins]])
        order = np.argsort(keys, kind="stable")
        return keys[order], counts[order]

    def tell(self, keys: np.ndarray, replies: np.ndarray) -> None:
        """Takes the replies to what :meth:`ask` asked: totals, or 0 where no other chunk asked."""
        if self.totals:
            own = self.learnt(len(self.keys))
            shared = np.zeros(len(own), bool)
            shared[self.asked[-1]] = replies > 0
            own[self.asked[-1]] = np.where(replies > 0, replies, own[self.asked[-1]])
            self.totals.append(own)
            self.shared.append(shared)
            return
        self.begin_total = int(replies[np.searchsorted(keys, _BEGIN)]) or self.begins
        for level in (1, 2):
            told = replies[np.searchsorted(keys, self.keys[level - 1])]
            self.shared.append(told > 0)
            self.totals.append(np.where(told > 0, told, self.learnt(level)))


class Automaton:
    """The part of the model that a chunk's texts can reach.

    State 0 is the empty context, state 1 the begin, the others are contexts seen in training. An arc
    (state, token) holds log10 p(token | context) of an n-gram seen in training, and the state of the
    longest context that ends in the token. A token without an arc follows the failure arc to the
    context without its first token, which adds the backoff weight, and tries there; in state 0 every
    token has an arc.
    """

    def __init__(self, grams: Grams, order: int, n_tokens: int, n_types: int, prior: float):
        self.order, self.width = order, len(grams.keys[0])
        unigram = grams.totals[0]
        p = (unigram + 0.5) / (n_tokens + 0.5 * (n_types + 1))
        self.root = np.log10(p)
        # state of the k tokens up to each token, or -1
        known = np.where(unigram > 0, np.arange(self.width) + 2, -1)
        reached = [known[grams.place[0]]]
        self.root_next = np.maximum(known, 0)
        counts, fail_to, states = [np.array([0, grams.begin_total]), unigram], [np.zeros(2 + self.width, np.int64)], 2 + self.width
        for k in range(2, order):
            place, totals = grams.place[k - 1], grams.totals[k - 1]
            own = np.full(len(totals), -1)
            good = totals >= grams.min_context
            own[good] = np.arange(states, states + int(good.sum()))
            reached.append(np.where(place >= 0, own[place] if len(own) else -1, -1))
            one = some_place(place, len(totals))
            fail_to.append(reached[k - 2][one[good]])
            counts.append(totals[good])
            states += int(good.sum())
        count = np.concatenate(counts).astype(float)
        self.fail = np.log10(prior / (count + prior))
        self.fail[0] = 0.0
        self.fail_to = np.concatenate(fail_to)
        codes, weights, nexts = [], [], []
        lower = p
        for k in range(1, order):
            place, totals = grams.place[k], grams.totals[k]
            one = some_place(place, len(totals))
            state = grams.before(reached[k - 1], 1 if k == 1 else -1)[one]
            context = count[np.maximum(state, 0)] * (state > 0)
            lower = (totals + prior * lower[grams.place[k - 1][one]]) / (context + prior)
            seen = (totals > 0) & (state > 0)
            to = np.zeros(len(one), np.int64)
            for r in reached[: k + 1]:
                to = np.where(r[one] >= 0, r[one], to)
            codes.append(state[seen] * self.width + grams.place[0][one[seen]])
            weights.append(np.log10(lower[seen]))
            nexts.append(to[seen])
        codes, weights, nexts = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((codes, np.int64), (weights, float), (nexts, np.int64)))
        by = np.argsort(codes)
        codes, self.weights, self.nexts = codes[by], weights[by], nexts[by]
        # a state with one arc knows its token; those with more are searched for
        state = codes // self.width
        first = np.searchsorted(state, np.arange(states + 1))
        arcs = np.diff(first)
        self.several = arcs > 1
        self.only = np.where(arcs == 1, first[:-1], -1)
        self.only_code = np.where(arcs == 1, codes[np.minimum(first[:-1], len(codes) - 1)], -1) if len(codes) else np.full(states, -1)
        self.at = np.flatnonzero(self.several[state])
        self.codes = codes[self.at]

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One token for each of many documents: (log10 probabilities, next states)."""
        out, to = np.zeros(len(state)), np.zeros(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            at_root = state == 0
            done = left[at_root]
            out[done] += self.root[token[at_root]]
            to[done] = self.root_next[token[at_root]]
            left, state, token = left[~at_root], state[~at_root], token[~at_root]
            if not len(left):
                break
            code = state * self.width + token
            arc = self.only_code[state] == code
            at = np.where(arc, self.only[state], 0)
            wide = np.flatnonzero(self.several[state])
            if len(wide):
                found = np.minimum(np.searchsorted(self.codes, code[wide]), len(self.codes) - 1)
                arc[wide] = self.codes[found] == code[wide]
                at[wide] = self.at[found]
            out[left[arc]] += self.weights[at[arc]]
            to[left[arc]] = self.nexts[at[arc]]
            left, state, token = left[~arc], state[~arc], token[~arc]
            out[left] += self.fail[state]
            state = self.fail_to[state]
        return out, to

    def traverse(self, tokens: np.ndarray, counts: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
        """log10 probability of every token, documents left to right, many at once, each with its state.

        Long documents go in segments. The state depends on the last order - 1 tokens only, so a later
        segment starts so many tokens earlier in the empty context and forgets what they weigh.
        """
        starts = np.cumsum(counts) - counts
        segment = max(segment, self.order)
        cuts = -(-counts // segment)
        doc = np.repeat(np.arange(len(counts)), cuts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        early = np.where(nth > 0, self.order - 1, 0)
        at = starts[doc] + nth * segment - early
        length = np.minimum(counts[doc] - nth * segment, segment) + early
        by = np.argsort(-length, kind="stable")
        at, length, early = at[by], length[by], early[by]
        state = (early == 0).astype(np.int64)
        out = np.empty(len(tokens))
        active = len(at)
        for k in range(int(length[0]) if len(length) else 0):
            active = int(np.searchsorted(-length[:active], -k, side="left"))
            where = at[:active] + k
            weight, state = self.step(state[:active], tokens[where])
            counted = k >= early[:active]
            out[where[counted]] = weight[counted]
        return out


def corpus_size(docs: DataFrame, text: str, train: str, shard_keys: int = SHARD_KEYS) -> tuple[int, int, int, int]:
    """(training tokens, distinct training tokens, all tokens, characters) over all rows.

    Each block of texts sends its distinct tokens, packed, to shards that count them once.
    """
    n_chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, n_chars / 20 / shard_keys))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learn = np.array(batch.column(1).to_pylist(), bool)
            for part in arrow_blocks(batch.column(0)):
                tokens, counts = _tokens(part_of(batch.column(0), part))
                mine = np.repeat(learn[part], counts)
                cut = _sharded(np.unique(tokens[mine]), bits)
                rows = [(s, int(mine.sum()) if k == 0 else 0, len(tokens) if k == 0 else 0, *pack_keys(keys)) for k, (s, keys) in enumerate(cut or [(0, np.zeros(0, np.uint64))])]
                types = (pa.int64(),) * 3 + (pa.binary(),) * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["shard", "learnt", "tokens", "keys", "gaps", "far"])

    def distinct(table: pa.Table) -> pa.Table:
        keys = [unpack_keys(*x) for x in zip(*(table.column(c).to_pylist() for c in ("keys", "gaps", "far")))]
        return pa.table({"learnt": [int(table.column("learnt").to_numpy().sum())], "tokens": [int(table.column("tokens").to_numpy().sum())], "types": [len(np.unique(np.concatenate(keys)))]})

    parts = docs.select(text, train).mapInArrow(count, "shard long, learnt long, tokens long, keys binary, gaps binary, far binary")
    r = parts.groupBy("shard").applyInArrow(distinct, "learnt long, tokens long, types long").agg(*[F.sum(c).alias(c) for c in ("learnt", "types", "tokens")]).first()
    return r["learnt"] or 0, r["types"] or 0, r["tokens"] or 0, n_chars


def _sharded(keys: np.ndarray, bits: int) -> list[tuple[int, np.ndarray]]:
    """Sorted keys cut by their first ``bits`` bits: (shard, keys)."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.diff(shard, prepend=-1))
    return [(int(shard[i]), keys[i:j]) for i, j in zip(starts, [*starts[1:], len(keys)])]


def score_texts(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    prior: float = PRIOR,
    order: int = ORDER,
    min_context: int = MIN_CONTEXT,
    chunk_chars: int = CHUNK_CHARS,
    shard_keys: int = SHARD_KEYS,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    The model learns from the whole texts of all rows where ``train`` is true (null: false). A token
    is a word or the end of a text. Without a context its probability p is (c + 0.5) / (N + 0.5 * (V +
    1)), of which ``base_score`` is the log10 sum. After a context h it is (c(h token) + prior * p') /
    (c(h) + prior), with p' that after h without its first token; contexts have up to ``order`` - 1
    (at least 1) tokens or the begin of the text, and one of two or more counts if training has it
    ``min_context`` times. Null texts count as empty and have their end as only token. Repeated rows
    are counted and returned each time. Without training rows every token is unknown and has p = 1.
    An empty table gives no rows. Other columns of ``docs`` are not returned.

    The model grows with the corpus and is nowhere whole. Rows are dealt to chunks of bounded size by
    their place in ``docs``, so copies of one row spread; a task that is run again must find its rows in
    the same order, as it does in a table (write what a shuffle gives first). Each chunk sends the
    sorted distinct keys of its n-grams, with its training counts, to shards of the key space, at most
    one entry a key and chunk however frequent the n-gram. A shard adds up and returns the totals in
    the order asked; longer n-grams follow in a round of their own, for the contexts that the round
    before made states and only where both shorter parts occur in several chunks. So each chunk builds its
    own automaton and traverses its texts. The texts move once: all rounds read one exchange. There
    is a row for each chunk and shard, so both should grow with the memory of the executors.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    n_train, n_types, n_tokens, n_chars = corpus_size(base, "text", "train", shard_keys)
    n_chunks = max(1, -(-n_chars // chunk_chars))
    bits = max(0, math.ceil(math.log2(max(1, n_tokens) / shard_keys)))
    chunked = base.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_chunks)))
    rounds = max(1, order - 1)

    def gathered(texts_of: pa.Table, answers: pa.Table | None) -> Grams:
        """The chunk's n-grams with the totals of all rounds answered so far."""
        grams = Grams(texts_of.column("text").to_pylist(), np.array(texts_of.column("train").to_pylist(), bool), min_context)
        if answers is not None and answers.num_rows:
            answers = answers.sort_by([("round", "ascending"), ("shard", "ascending")])
            of = answers.column("round").to_numpy()
            counts = [unpack_counts(a, b) for a, b in zip(answers.column("counts").to_pylist(), answers.column("large").to_pylist())]
            for r in range(int(of.max()) + 1):
                keys, _ = grams.ask()
                held = [c for c, k in zip(counts, of) if k == r]
                grams.tell(keys, np.concatenate(held) if held else np.zeros(0, np.int64))
        return grams

    def ask(chunk: int, grams: Grams, r: int) -> pa.Table:
        keys, learnt = grams.ask()
        cut = _sharded(keys, bits)
        ends = np.cumsum([len(k) for _, k in cut])
        packed = [(*pack_keys(k), *pack_counts(learnt[e - len(k) : e])) for (_, k), e in zip(cut, ends)]
        n = len(cut)
        binary = {name: pa.array([x[k] for x in packed], pa.binary()) for k, name in enumerate(("keys", "gaps", "far", "counts", "large"))}
        return pa.table({"shard": pa.array([s for s, _ in cut], pa.int64()), "chunk": pa.array([chunk] * n, pa.int64()), "round": pa.array([r] * n, pa.int32()), **binary})

    def first(key: tuple, table: pa.Table) -> pa.Table:
        return ask(key[0].as_py(), gathered(table, None), 0)

    def further(r: int):
        def run(key: tuple, texts_of: pa.Table, answers: pa.Table) -> pa.Table:
            return ask(key[0].as_py(), gathered(texts_of, answers), r)

        return run

    def answer(table: pa.Table) -> pa.Table:
        column = lambda n: table.column(n).to_pylist()
        asked = [unpack_keys(*x) for x in zip(column("keys"), column("gaps"), column("far"))]
        counts = [unpack_counts(*x) for x in zip(column("counts"), column("large"))]
        keys, place = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.bincount(place, np.concatenate(counts), minlength=len(keys)).astype(np.int64)
        totals[np.bincount(place, minlength=len(keys)) == 1] = 0  # the one chunk that asked knows its own count
        ends = np.cumsum([len(a) for a in asked])
        packed = [pack_counts(totals[place[e - len(a) : e]]) for a, e in zip(asked, ends)]
        return pa.table({"chunk": table.column("chunk"), "round": table.column("round"), "shard": table.column("shard"), "counts": pa.array([a for a, _ in packed], pa.binary()), "large": pa.array([b for _, b in packed], pa.binary())})

    def score(texts_of: pa.Table, answers: pa.Table) -> pa.Table:
        grams = gathered(texts_of, answers)
        while len(grams.totals) < order and len(grams.totals) < rounds + 1:  # rounds in which the chunk had nothing to ask
            keys, _ = grams.ask()
            grams.tell(keys, np.zeros(len(keys), np.int64))
        automaton = Automaton(grams, rounds + 1, n_train, n_types, prior)
        local = grams.place[0]
        logs = automaton.traverse(local, grams.counts)
        known = grams.totals[0][local] > 0
        whole = lambda x: np.bincount(grams.doc, x, minlength=texts_of.num_rows)
        return pa.table({"doc_id": texts_of.column("doc_id"), "n_tokens": pa.array(grams.counts), "n_known": pa.array(whole(known).astype(np.int64)), "base_score": pa.array(whole(automaton.root[local])), "score": pa.array(whole(logs))})

    asks, replies = "shard long, chunk long, round int, keys binary, gaps binary, far binary, counts binary, large binary", "chunk long, round int, shard long, counts binary, large binary"
    answers = None
    for r in range(rounds):
        by_chunk = chunked.groupBy("chunk")
        asked = by_chunk.applyInArrow(first, asks) if answers is None else by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(further(r), asks)
        new = asked.groupBy("shard").applyInArrow(answer, replies)
        answers = new if answers is None else answers.unionByName(new)
    id_type = docs.schema[id_col].dataType.simpleString()
    scored = chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, f"doc_id {id_type}, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("doc_id").alias(id_col), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums are rounded to 6 decimals, because the order of their terms may differ."""
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))
    scored = score_texts(read(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


OP4_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM range(256) t(i)
), d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 5 = 1, FALSE) AS held_out,
         list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' end') AS tokens
  FROM documents, crc_table
), t AS (
  SELECT r, held_out, unnest(tokens) AS token, unnest(list_prepend(' begin', tokens[:-2])) AS before, unnest(list_concat([NULL, ' begin'], tokens[:-3])[:len(tokens)]) AS before2 FROM d
), uni AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token),
pairs AS (SELECT before, token, count(*) AS c FROM t WHERE NOT held_out GROUP BY before, token),
triples AS (SELECT before2, before, token, count(*) AS c FROM t WHERE NOT held_out AND before2 IS NOT NULL GROUP BY ALL),
context AS (SELECT token AS before, c FROM uni UNION ALL SELECT ' begin', count(*) FROM d WHERE NOT held_out),
size AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM uni),
scored AS (
  SELECT r, coalesce(uni.c, 0) AS c, (coalesce(uni.c, 0) + CAST(0.5 AS DOUBLE)) / (n + CAST(0.5 AS DOUBLE) * (v + 1)) AS p,
         coalesce(pairs.c, 0) AS pair_c, coalesce(context.c, 0) AS context_c,
         coalesce(triples.c, 0) AS triple_c, coalesce(longer.c, 0) AS longer_c
  FROM t CROSS JOIN size LEFT JOIN uni USING (token) LEFT JOIN pairs ON pairs.before = t.before AND pairs.token = t.token
  LEFT JOIN context ON context.before = t.before LEFT JOIN triples ON triples.before2 = t.before2 AND triples.before = t.before AND triples.token = t.token
  LEFT JOIN pairs longer ON longer.before = t.before2 AND longer.token = t.before
), smoothed AS (
  SELECT *, (pair_c + CAST(128 AS DOUBLE) * p) / (context_c + CAST(128 AS DOUBLE)) AS p2 FROM scored
), summed AS (
  SELECT r, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, fsum(log10(p)) AS base_score,
         fsum(log10(CASE WHEN longer_c > 0 THEN (triple_c + CAST(128 AS DOUBLE) * p2) / (longer_c + CAST(128 AS DOUBLE)) ELSE p2 END)) AS score
  FROM smoothed GROUP BY r
)
SELECT doc_id, held_out, n_tokens, n_known, CAST(n AS BIGINT) AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score
FROM summed JOIN d USING (r) CROSS JOIN size
"""
