"""Toxicity by maximum-scoring segments of token log-odds.

Training counts how many labelled documents of each class hold a word and its
first letters. A token's log-odds come from a chain of Dirichlet priors: the
word leans on its first five letters, these on its first four, and these on
the classes' overall shares. Scanning a text in linear time finds every maximal
segment of positive sum. Extreme-value statistics (lambda from the clean
tokens' scores, K from the best segments of clean documents) turn a sum into
the number of such segments that chance would give in a text of that length;
the significant segments add up to the evidence, and a logistic curve fitted
out of fold maps evidence to a score.

Counts live in ``BUCKETS`` hashed cells for each class and fold, so the model
has one size whatever the vocabulary. The classifier is fitted on at most
``TRAIN_DOCS`` labelled documents, chosen by hash; scoring covers every text.
"""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.batches import give_back, read_words
from hydrolith.llm.common import cut, small_batches, table

BUCKETS = 1 << 18
TRAIN_DOCS = 40_000
HELD_OUT = 5
#: Strength of the priors, as a number of documents.
PRIOR = 4.0
#: Added to each log-odds, so that clean text drifts down.
DRIFT = -1.0
LEAST, MOST = -3.0, 6.0
#: Segments that chance gives this often in a clean text are not significant.
E_VALUE = 0.05
#: Marks that are taken off both ends of a word.
MARKS = string.punctuation + "«»„“”‘’…–—¡¿"


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo ``HELD_OUT``; a null id is in fold 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HELD_OUT)), F.lit(1)).cast("int")


def cells(words: list[str]) -> np.ndarray:
    """(words, 3) cells of a word's first four and five letters and of the word
    without marks around it, in lower case; -1 if nothing is left of it."""
    out = np.full((len(words), 3), -1, np.int64)
    for i, word in enumerate(words):
        w = word.strip(MARKS).lower()
        if w:
            b = w.encode("utf-8", "surrogatepass")
            out[i] = zlib.crc32(b"4" + w[:4].encode("utf-8", "surrogatepass")), zlib.crc32(b"5" + w[:5].encode("utf-8", "surrogatepass")), zlib.crc32(b"w" + b)
    return np.where(out >= 0, out % BUCKETS, -1)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, sum), in one scan.

    A candidate keeps the sum before it and up to its end; a new one merges
    with earlier candidates that begin lower and end lower, back along links.
    """
    hot = np.flatnonzero(scores > 0)
    if not len(hot):
        return []
    total = np.r_[0.0, np.cumsum(scores)]
    # Neighbouring positive tokens always belong together.
    first = np.r_[True, np.diff(hot) > 1]
    begins, ends = hot[first], np.r_[hot[np.flatnonzero(first)[1:] - 1], hot[-1]] + 1
    stack: list[list] = []  # begin, end, sum before, sum up to the end, link
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        left, right = total[b], total[e]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append([b, e, left, right, j])
                break
            b, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(b, e, r - lo) for b, e, lo, r, _ in stack]


@dataclass
class Model:
    counts: np.ndarray  # (2 halves, 2 classes, BUCKETS) documents
    docs: np.ndarray  # (2 halves, 2 classes)
    scale: float = 1.0  # lambda
    log_k: float = 0.0
    curve: tuple[float, float] = (-4.0, 1.0)

    def log_odds(self, words: list[str], half: int | None = None) -> np.ndarray:
        """Drifted log-odds of words; ``half`` leaves that half's counts out. A
        word of marks alone has 0."""
        keep = [h for h in (0, 1) if h != half]
        n = self.docs[keep].sum(0)
        base = math.log((n[1] + 0.5) / (n[0] + 0.5))
        at = cells(words)
        share = np.full(len(words), (n[1] + 0.5) / (n.sum() + 1.0))
        for level in range(3):
            c = self.counts[keep].sum(0)[:, at[:, level]] if half is None else self.counts[1 - half][:, at[:, level]]
            share = (c[1] + PRIOR * share) / (c[0] + c[1] + PRIOR)
        share = np.clip(share, 1e-6, 1 - 1e-6)
        s = np.clip(np.log(share / (1 - share)) - base + DRIFT, LEAST, MOST)
        return np.where(at[:, 0] >= 0, s, 0.0)

    def evidence(self, scores: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
        """Sum over significant segments of minus the log of their E-value (or
        that of the best segment), and those segments with their E-values."""
        found = segments(scores)
        if not found:
            return -math.log(len(scores) + 2.0) - 2.0, []
        rate = [(b, e, math.exp(min(50.0, self.log_k + math.log(len(scores) + 1.0) - self.scale * s))) for b, e, s in found]
        good = [x for x in rate if x[2] <= E_VALUE]
        each = [-math.log(max(x[2], 1e-30)) for x in (good or [min(rate, key=lambda x: x[2])])]
        return sum(each), good

    def probability(self, evidence: float) -> float:
        a, b = self.curve
        squeezed = math.copysign(math.sqrt(abs(evidence)), evidence)
        return 1.0 / (1.0 + math.exp(-min(max(a + b * squeezed, -40.0), 40.0)))


class Scorer:
    """Scores of texts; a word's is computed once while the store has room."""

    def __init__(self, model: Model, half: int | None = None, most: int = 400_000):
        self.model, self.half, self.most = model, half, most
        if half is None:  # one table instead of two halves
            self.model = Model(model.counts.sum(0, keepdims=True).repeat(2, 0) / 2, model.docs, model.scale, model.log_k, model.curve)
        self.place: dict[str, int] = {}
        self.values = np.zeros(0)

    def __call__(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        own, index, ends = read_words(texts)
        new = [w for w in own if w not in self.place]
        if len(self.place) + len(new) > self.most:
            self.place, self.values, new = {}, np.zeros(0), own
        if new:
            self.place.update(zip(new, range(len(self.values), len(self.values) + len(new)), strict=True))
            self.values = np.r_[self.values, self.model.log_odds(new, self.half)]
        s = self.values[np.fromiter(map(self.place.__getitem__, own), np.int64, len(own))][index]
        give_back()
        return [s[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def scored(scorers: list[Scorer], b: pa.RecordBatch) -> list[np.ndarray]:
    """Scores of labelled texts, each by the counts of the other half."""
    half = b.column("half").to_numpy()
    out: list[np.ndarray] = [np.zeros(0)] * len(half)
    for h in (0, 1):
        own = np.flatnonzero(half == h)
        for i, s in zip(own.tolist(), scorers[h](b.column("text").take(pa.array(own))), strict=True):
            out[i] = s
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, docs = np.zeros(4 * BUCKETS, np.int64), np.zeros(4, np.int64)
    for b in batches:
        kind = 2 * b.column("half").to_numpy().astype(np.int64) + b.column("toxic").to_numpy()
        docs += np.bincount(kind, minlength=4)
        own, index, ends = read_words(b.column("text"))
        of = np.repeat(np.arange(len(kind)), np.diff(ends))
        pair = np.unique(of * len(own) + index)  # a word once in a document
        doc, at = pair // max(len(own), 1), cells(own)[pair % max(len(own), 1)]
        hit = np.unique((doc[:, None] * BUCKETS + at)[at >= 0])
        counts += np.bincount(kind[hit // BUCKETS] * BUCKETS + hit % BUCKETS, minlength=4 * BUCKETS)
    (place,) = np.nonzero(counts)
    n = np.r_[counts[place], docs]
    yield pa.RecordBatch.from_pydict({"kind": pa.array(np.r_[place // BUCKETS, np.arange(4)], pa.int32()), "cell": pa.array(np.r_[place % BUCKETS, np.full(4, -1)], pa.int32()), "n": pa.array(n, pa.int64())})


def training(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """text, toxic, half of labelled documents outside the held-out fold. A
    document whose labels disagree takes the commoner one, toxic in a tie."""
    one = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    one = one.filter(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    n = one.count()
    if n > most:  # a share by hash; ``most`` within sampling error
        one = one.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    one = one.withColumn("half", F.when(fold(F.col("doc_id")) <= 2, 0).otherwise(1))
    return docs.select("doc_id", "text").join(F.broadcast(one), "doc_id").select("text", "toxic", "half")


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Without labels of both classes every score is 0.5 or less and constant."""
    small_batches(docs.sparkSession)
    train = cut(training(docs, labels, most))
    # At most 4 * (BUCKETS + 1) rows of 16 bytes, whatever the documents.
    rows = train.mapInArrow(_counts, "kind int, cell int, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).toArrow()
    kind, cell, count = (rows.column(c).to_numpy() for c in ("kind", "cell", "n"))
    counts, n = np.zeros((4, BUCKETS), np.float32), np.zeros(4)
    own = cell >= 0
    counts[kind[own], cell[own]] = count[own]
    n[kind[~own]] = count[~own]
    model = Model(counts.reshape(2, 2, BUCKETS), n.reshape(2, 2))
    if n.reshape(2, 2).sum(0).min() == 0:
        model.curve = (-1.0, 0.0)
        return model

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Clean tokens' scores by tenths, and each clean text's best segment."""
        scorers = [Scorer(model, h) for h in (0, 1)]
        for b in batches:
            b = b.filter(pc.equal(b.column("toxic"), 0))
            each = scored(scorers, b)
            hist = np.bincount(np.rint((np.concatenate([*each, np.zeros(0)]) + 10) * 10).astype(int), minlength=200)[:200]
            tops = [(len(s), max((x[2] for x in segments(s)), default=0.0)) for s in each]
            yield pa.RecordBatch.from_pydict({
                "cell": pa.array([*range(200), *[-1] * len(tops)], pa.int32()),
                "n": pa.array([*hist.tolist(), *[t[0] for t in tops]], pa.int64()),
                "top": pa.array([*[0.0] * 200, *[t[1] for t in tops]], pa.float64()),
            })

    clean = train.mapInArrow(statistics, "cell int, n long, top double")
    bounded = clean.groupBy("cell", F.when(F.col("cell") < 0, F.floor(F.log2(F.col("n") + 1) * 2)).alias("size"), F.when(F.col("cell") < 0, F.round("top", 1)).alias("top")).agg(F.sum(F.when(F.col("cell") >= 0, F.col("n")).otherwise(1)).alias("n"), F.avg("n").alias("long")).toArrow().to_pandas()
    hist = bounded[bounded["cell"] >= 0]
    value, weight = hist["cell"].to_numpy() / 10 - 10, hist["n"].to_numpy(float)
    model.scale = karlin_scale(value, weight / max(weight.sum(), 1))
    tops = bounded[(bounded["cell"] < 0) & (bounded["top"] > 0)]
    if len(tops):
        gap = model.scale * tops["top"] - np.log(tops["long"] + 1)
        model.log_k = float(np.average(gap, weights=tops["n"]) - 0.5772)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(model, h) for h in (0, 1)]
        for b in batches:
            x = [model.evidence(s)[0] for s in scored(scorers, b)]
            yield pa.RecordBatch.from_pydict({"x": pa.array(np.rint(np.sign(x) * np.sqrt(np.abs(x)) * 10).astype(int), pa.int64()), "y": b.column("toxic")})

    curve = train.mapInArrow(weighed, "x long, y int").groupBy("x", "y").count().toArrow().to_pandas()
    model.curve = logistic(curve["x"].to_numpy() / 10, curve["y"].to_numpy(float), curve["count"].to_numpy(float))
    return model


def karlin_scale(value: np.ndarray, share: np.ndarray) -> float:
    """The positive lambda with sum(share * exp(lambda * value)) = 1."""
    if (share * value).sum() >= 0 or not (share[value > 0] > 0).any():
        return 1.0
    lo, hi = 1e-6, 1e-3
    f = lambda x: float((share * np.exp(np.minimum(x * value, 500))).sum()) - 1
    while f(hi) < 0 and hi < 50:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return min(hi, 20.0)


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Intercept and slope by Newton steps, with a small ridge on the slope."""
    w = np.zeros(2)
    design = np.c_[np.ones(len(x)), x]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (n * (y - p)) - np.array([0, ridge]) * w
        hess = (design * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + np.diag([1e-6, ridge])
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(max(w[1], 0.0))


RESULT = "doc_id long, score double, evidence double, n_segments int, segments string"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence, n_segments and segments.

    ``segments`` has begin:end of each significant segment, counted in the words
    of the text that white space parts. A row for each row; null and empty texts
    get the score of no evidence; equal texts get equal scores."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, scorer = shared.value, Scorer(shared.value)
        for b in batches:
            rows = []
            for s in scorer(b.column("text")):
                e, good = m.evidence(s)
                rows.append((m.probability(e), e, len(good), ",".join(f"{x}:{y}" for x, y, _ in good)))
            p, e, n, g = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64()), pa.array(e, pa.float64()), pa.array(n, pa.int32()), pa.array(g, pa.string())], names=["doc_id", "score", "evidence", "n_segments", "segments"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def kept(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is under ``limit``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, scorer = shared.value, Scorer(shared.value)
        for b in batches:
            good = [m.probability(m.evidence(s)[0]) < limit for s in scorer(b.column("text"))]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    s = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return s.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_segments", "segments")
