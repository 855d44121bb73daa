"""Quality classifier: a sparse ensemble of tree rules over text statistics, compiled to Spark columns."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read
from .words import arrow_blocks, part_of, word_hashes

#: The classifier is fitted on this many labelled rows at most: those with the smallest hash of their id.
MAX_LABELLED = 20_000
THRESHOLD = 0.3


FEATURES = ("chars", "words", "word_length", "line_words", "upper", "digits", "stops", "shouts", "marks", "bars", "word_repeats", "line_repeats")
#: Bytes that are classified at once.
BLOCK = 2_000_000

_SPACE, _LINE, _UPPER, _DIGIT, _STOP, _SHOUT, _MARK, _BAR = (1 << k for k in range(8))
_CLASS = np.zeros(256, np.uint8)
for _bit, _chars in ((_SPACE, b" \t\n\v\f\r"), (_LINE, b"\n"), (_UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_DIGIT, b"0123456789"), (_STOP, b".,;:"), (_SHOUT, b"!?"), (_MARK, b"#$%&*@^_~=+<>/\\|{}[]"), (_BAR, b"|")):
    _CLASS[list(_chars)] |= _bit


def _byte_counts(data: np.ndarray, ends: np.ndarray) -> dict[int, np.ndarray]:
    """Of each text (bytes up to its end) the bytes of each class, the word starts (0) and the characters (-1)."""
    starts = np.concatenate([[0], ends[:-1]])
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    out = {k: np.zeros(len(ends), np.int64) for k in (-1, 0, _SPACE, _LINE, _UPPER, _DIGIT, _STOP, _SHOUT, _MARK, _BAR)}
    for at in range(0, len(data), BLOCK):
        b = data[at : at + BLOCK]
        kind = _CLASS[b]
        space = (kind & _SPACE) > 0
        before = np.empty(len(b), bool)
        before[1:] = space[:-1]
        before[0] = at == 0 or bool(_CLASS[data[at - 1]] & _SPACE)
        before |= first[at : at + len(b)]
        upper = (kind & _UPPER) > 0
        upper[1:] |= (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)  # capitals with an accent
        low, high = np.clip(starts - at, 0, len(b)), np.clip(ends - at, 0, len(b))
        some = np.flatnonzero(high > low)
        for key, mask in ((-1, (b & 0xC0) != 0x80), (0, before & ~space), (_UPPER, upper), *((k, (kind & k) > 0) for k in (_SPACE, _LINE, _DIGIT, _STOP, _SHOUT, _MARK, _BAR))):
            total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
            out[key][some] += total[high[some]] - total[low[some]]
    return out


def text_statistics(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The statistics of whole texts; null counts as empty, and every ratio of an empty text is 0."""
    texts = [t or "" for t in texts]
    encoded = [t.encode(errors="surrogatepass") for t in texts]
    ends = np.cumsum([len(e) for e in encoded]) if encoded else np.zeros(0, np.int64)
    n = _byte_counts(np.frombuffer(b"".join(encoded), np.uint8), ends)
    chars, words, lines = n[-1], n[0], n[_LINE] + 1
    hashes, counts = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    again = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner[1:][again], minlength=len(texts))
    doubled = [sum(map(str.__eq__, parts, parts[1:])) if len(parts := t.split("\n")) > 1 else 0 for t in texts]
    share = lambda part, whole: np.divide(part, whole, out=np.zeros(len(texts)), where=whole > 0)
    values = (np.log1p(chars), np.log1p(words), share(chars - n[_SPACE], words), share(words, lines * (chars > 0)), share(n[_UPPER], chars), share(n[_DIGIT], chars), share(n[_STOP], words), share(n[_SHOUT], words), share(n[_MARK], chars), share(n[_BAR], words), share(repeats, words), share(np.array(doubled, float), lines))
    return dict(zip(FEATURES, values))


def statistics(text: Column) -> Column:
    """The statistics of a whole text as a struct; see :func:`text_statistics`."""

    @F.arrow_udf(T.StructType([T.StructField(f, T.DoubleType()) for f in FEATURES]))
    def measure(texts: pa.Array) -> pa.Array:
        parts = [text_statistics(part_of(texts, part)) for part in arrow_blocks(texts)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([p[f] for p in parts]) if parts else np.zeros(0)) for f in FEATURES], names=list(FEATURES))

    return measure(text)


class Condition(NamedTuple):
    feature: int
    above: bool  # value > cut, else value <= cut
    cut: float


class RuleModel(NamedTuple):
    features: tuple[str, ...]
    rules: tuple[tuple[Condition, ...], ...]
    weights: tuple[float, ...]
    bias: float


def _tree(codes: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, path: tuple, cuts: list, out: list) -> np.ndarray:
    """Grows one regression tree on binned features; adds the path of every node to ``out``; returns the step of each of ``rows``."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    if path:
        out.append(path)
    step = np.full(len(rows), -g / (h + 1.0))
    if depth == 0 or len(rows) < 20:
        return step
    best = (1e-6, -1, 0)
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        c = codes[rows, f]
        gs = np.cumsum(np.bincount(c, gradient[rows], len(edges) + 1))[:-1]
        hs = np.cumsum(np.bincount(c, hessian[rows], len(edges) + 1))[:-1]
        ns = np.cumsum(np.bincount(c, minlength=len(edges) + 1))[:-1]
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
        gain[(ns < 5) | (len(rows) - ns < 5)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, k)
    if best[1] < 0:
        return step
    _, f, k = best
    low = codes[rows, f] <= k
    for side, above in ((low, False), (~low, True)):
        step[side] = _tree(codes, gradient, hessian, rows[side], depth - 1, (*path, Condition(f, above, float(cuts[f][k]))), cuts, out)
    return step


def _holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= (x[:, c.feature] > c.cut) if c.above else (x[:, c.feature] <= c.cut)
    return out


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Lasso logistic regression by accelerated proximal gradient; the bias is not penalised."""
    n, k = z.shape
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rate = 4.0 / max(1.0, float(np.linalg.eigvalsh(z.T @ z / n)[-1]) + 1.0)
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        slack = 1 / (1 + np.exp(-np.clip(z @ vw + vb, -40, 40))) - y
        nw = vw - rate * (z.T @ slack) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb = vb - rate * slack.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray, features: tuple[str, ...], trees: int = 30, depth: int = 3, bins: int = 64, penalty: float = 0.002, steps: int = 600) -> RuleModel:
    """Boosts small trees, takes the path to every node as a rule, and weighs the rules by lasso logistic regression.

    Without both classes among the labels the model has no rules and scores every text by the share
    of label 1, smoothed (0.5 without labels).
    """
    y = np.asarray(y, float)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(features, (), (), float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        margin += 0.3 * _tree(codes, p - y, p * (1 - p), np.arange(len(y)), depth, (), cuts, paths)
    rules = sorted(set(paths))
    z = np.stack([_holds(r, x) for r in rules], axis=1).astype(float)
    w, b = _lasso(z, y, penalty, steps)
    used = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleModel(features, tuple(rules[i] for i in used), tuple(float(w[i]) for i in used), float(b))


def compile_score(model: RuleModel, columns: dict[str, str]) -> Column:
    """The model as one column expression over the statistics, whose column names ``columns`` gives."""
    margin = F.lit(model.bias)
    for rule, weight in zip(model.rules, model.weights):
        holds = F.lit(True)
        for c in rule:
            value = F.col(columns[model.features[c.feature]])
            holds &= (value > c.cut) if c.above else (value <= c.cut)
        margin += F.when(holds, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-margin))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> RuleModel:
    """Fits the classifier on at most ``max_labelled`` labelled rows, those whose id has the smallest hash.

    Rows without an id or label are not learnt from; repeated labels of one id count once, the
    larger one, and so do repeated rows, the largest statistics. Only the sample's ids are collected
    and joined to the texts, as a side of at most ``max_labelled`` rows; one row of statistics an id
    comes to the driver. Ids may be of any type that both tables share.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("__label"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect()
    schema = T.StructType([labels.schema["doc_id"], T.StructField("__label", T.IntegerType())])
    chosen = spark.createDataFrame([(r["doc_id"], int(r["__label"])) for r in sample], schema)
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    measured = some.select("doc_id", "__label", statistics(F.col("text")).alias("__s"))
    rows = measured.groupBy("doc_id", "__label").agg(F.max("__s").alias("__s")).select("doc_id", "__label", "__s.*").toPandas()
    rows = rows.sort_values("doc_id").reset_index(drop=True)
    return fit_rules(rows[list(FEATURES)].to_numpy(float), rows["__label"].to_numpy(), FEATURES)


def score_quality(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` to every row; nothing shuffles.

    A null text is scored as an empty one. Columns of the two names in ``docs`` are replaced; ids,
    languages, sources and other columns do not enter the score.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    out = docs.select(*kept, statistics(F.col("text")).alias("__s"))
    out = out.withColumn("__score", compile_score(model, {f: f"__s.{f}" for f in FEATURES}))
    return out.select(*kept, F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5))


def learning_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    return labels.where(fold(F.col("doc_id")) != 0).select("doc_id", "quality")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, learning_labels(spark, sf_dir))
    out = score_quality(docs, model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
