"""Toxicity: non-negative positive-unlabelled learning of a linear numpy classifier, then scores for all documents."""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import held, held_out, mapped, small_batches, tidy

#: Documented bounds of the samples that the classifier is fitted on; scoring reads every document.
MAX_POSITIVE, MAX_UNLABELLED = 3000, 9000
BITS = 18
PREFIXES = (5, 7)
WORD = re.compile(r"[^\W\d_]+")
#: The prior is taken a little lower than the share of toxic labels, so that clean documents stay.
CAUTION = 0.95
#: A worker remembers the weights of so many words, then starts anew.
MEMO = 100_000


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of one distinct word: the word itself and its beginnings."""
    out = [zlib.crc32(b"w" + word.encode("utf-8", "replace")) >> (32 - BITS)]
    for n in PREFIXES:
        if len(word) >= n:
            out.append(zlib.crc32(b"p%d" % n + word[:n].encode("utf-8", "replace")) >> (32 - BITS))
    return tuple(out)


def distinct_words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def features(text: str | None) -> np.ndarray:
    ids = [f for w in distinct_words(text) for f in word_features(w)]
    return np.array(ids, dtype="<u4")


class Linear:
    """margin = bias + sum of the features' weights / (number of features + 50) ** 0.25; score = sigmoid(margin)"""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def margin(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.bias + total * (n + 50.0) ** -0.25

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.margin(np.array([self.weights[r].sum() for r in rows], "f8"), np.array([len(r) for r in rows], "f8"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _loss(g: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, g)


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 30, rate: float = 0.05, decay: float = 1e-3, least_z: float = 3.2, seed: int = 7) -> Linear:
    """Minimise prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)) with logistic loss, by Adam over mini-batches.

    Features are those whose shares of positive and unlabelled documents differ by least_z standard errors, scaled by
    the log of the ratio of the shares. Where the part in max() turns negative, the step goes the other way on it, so
    that the risk can't be driven below zero by fitting single documents.
    """
    rng, size = np.random.default_rng(seed), 1 << BITS
    base = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Linear(np.zeros(size, "f4"), base)
    p_n, u_n = len(positive), len(unlabelled)
    in_p, in_u = (np.bincount(np.concatenate([np.unique(r) for r in rows]).astype(np.int64), minlength=size) for rows in (positive, unlabelled))
    pool = (in_p + in_u + 1) / (p_n + u_n + 2)
    z = (in_p / p_n - in_u / u_n) / np.sqrt(pool * (1 - pool) * (1 / p_n + 1 / u_n))
    used = np.flatnonzero((np.abs(z) >= least_z) & (in_p + in_u >= 3))
    value = np.clip(np.log((in_p[used] + 0.5) / (p_n + 1) * (u_n + 1) / (in_u[used] + 0.5)), -3, 3)
    at = np.full(size, -1)
    at[used] = np.arange(len(used))
    rows = [*positive, *unlabelled]
    scale = (np.array([len(r) for r in rows], "f8") + 50.0) ** -0.25
    rows = [x[x >= 0] for x in (at[r] for r in rows)]
    w, m, v = (np.zeros(len(used)) for _ in range(3))
    bias, bm, bv, step = base, 0.0, 0.0, 0
    p_at, u_at = np.arange(p_n), np.arange(p_n, p_n + u_n)
    batches = max(1, min(20, u_n // 200))
    for _ in range(max(epochs, 600 // batches)):
        rng.shuffle(p_at)
        rng.shuffle(u_at)
        for b in range(batches):
            p, u = p_at[b::batches], u_at[b::batches]
            if not len(p) or not len(u):
                continue
            k, take = len(p), np.concatenate([p, u])
            flat = np.concatenate([rows[i] for i in take])
            row = np.repeat(np.arange(len(take)), [len(rows[i]) for i in take])
            g = bias + np.bincount(row, (w * value)[flat], len(take)) * scale[take]
            s, loss = _sigmoid(g), _loss(g)
            rest = loss[k:].mean() - prior * loss[:k].mean()
            sign = 1.0 if rest >= 0 else -1.0
            d = np.empty(len(take))
            d[k:] = sign * s[k:] / len(u)
            d[:k] = -sign * prior * s[:k] / k
            if rest >= 0:
                d[:k] += prior * (s[:k] - 1) / k
            grad = np.bincount(flat, (d * scale[take])[row], len(used)) * value + decay * w
            gb, step = d.sum(), step + 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            bm, bv = 0.9 * bm + 0.1 * gb, 0.999 * bv + 0.001 * gb**2
            a = rate * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            w -= a * m / (v**0.5 + 1e-8)
            bias -= a * bm / (bv**0.5 + 1e-8)
    full = np.zeros(size, "f4")
    full[used] = w * value
    return Linear(full, bias)


def calibrate(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """(a, b) of the probability sigmoid(a * margin + b), by the same risk over margins of documents that the
    classifier was not fitted on: E_U[log(1 + e^z)] - prior * E_P[z], convex in a and b; Newton's method."""
    sd = max(float(unlabelled.std()), 1e-6)
    p, u = positive / sd, unlabelled / sd
    at = np.array([1.0, -2.0])
    x = np.stack([u, np.ones_like(u)], 1)
    risk = lambda t: _loss(x @ t).mean() - prior * (t[0] * p + t[1]).mean() + 1e-4 * t[0] ** 2
    for _ in range(100):
        s = _sigmoid(x @ at)
        slope = x.T @ s / len(u) - prior * np.array([p.mean(), 1.0]) + np.array([2e-4 * at[0], 0])
        bend = (x * (s * (1 - s))[:, None]).T @ x / len(u) + np.diag([2e-4, 1e-8])
        step, t = np.linalg.solve(bend, slope), 1.0
        while risk(at - t * step) > risk(at) + 1e-12 and t > 1e-4:
            t /= 2
        at = at - t * step
        if np.abs(t * step).max() < 1e-7:
            break
    return max(at[0], 0.0) / sd, float(at[1])


def fit_calibrated(rows: list[np.ndarray], is_p: np.ndarray, is_u: np.ndarray, prior: float, folds: int = 3) -> Linear:
    """Mean of classifiers that each leave out a part of the documents, calibrated on the margins of the parts left out.

    is_p, is_u: which rows are confirmed, and which are unlabelled text; a row may be both.
    """
    fold = np.zeros(len(rows), int)
    fold[is_p], fold[~is_p] = np.arange(is_p.sum()) % folds, np.arange((~is_p).sum()) % folds
    some = lambda mask: [rows[i] for i in np.flatnonzero(mask)]
    if is_p.sum() < folds or is_u.sum() < folds:
        return fit_nnpu(some(is_p), some(is_u), prior)
    models, margin = [], np.zeros(len(rows))
    for k in range(folds):
        model = fit_nnpu(some(is_p & (fold != k)), some(is_u & (fold != k)), prior)
        margin[fold == k] = model.margins(some(fold == k))
        models.append(model)
    a, b = calibrate(margin[is_p], margin[is_u], prior)
    return Linear((a * np.mean([x.weights for x in models], 0)).astype("f4"), a * float(np.mean([x.bias for x in models])) + b)


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Linear:
    """Fit on samples of documents that aren't held out: confirmed toxic ones, and any ones as unlabelled text.

    The class prior is the share of toxic labels among the labels that aren't held out. Samples are the rows whose
    hashed ids are smallest, so they don't depend on the order or the partitions of the tables.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    prior = min(max(CAUTION * (prior or 0), 0.005), 0.5)
    order = F.xxhash64("doc_id", F.lit(11))
    p_ids = known.where("toxic = 1").select("doc_id").distinct().orderBy(order).limit(max_positive)
    u_ids = docs.select("doc_id").where("doc_id is not null").where(~held_out()).distinct().orderBy(order, "doc_id").limit(max_unlabelled)
    ids = p_ids.withColumn("p", F.lit(1)).unionByName(u_ids.withColumn("p", F.lit(0))).groupBy("doc_id").agg(F.max("p").alias("p"), F.min("p").alias("u"))
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "p", "u", "text")

    def found(batch: pa.RecordBatch):
        x = batch.to_pydict()
        yield {"doc_id": x["doc_id"], "p": x["p"], "u": x["u"], "f": [features(t).tobytes() for t in x["text"]]}

    got = sorted(mapped(sample, found, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, p int, u int, f binary").collect())
    rows = [np.frombuffer(bytes(r["f"]), "<u4") for r in got]
    return fit_calibrated(rows, np.array([r["p"] == 1 for r in got], bool), np.array([r["u"] == 0 for r in got], bool), prior)


def scores(texts: list[str | None], weights: np.ndarray, bias: float, model: str) -> np.ndarray:
    """model: a name of these weights, under which a worker remembers the weights of words."""
    memo = held(("toxicity", model), dict)
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for i, text in enumerate(texts):
        if len(memo) > MEMO:
            memo.clear()
        s = k = 0
        for word in distinct_words(text):
            got = memo.get(word)
            if got is None:
                f = word_features(word)
                got = memo[word] = (float(sum(weights[j] for j in f)), len(f))
            s += got[0]
            k += got[1]
        total[i], n[i] = s, k
    return _sigmoid(Linear(weights, bias).margin(total, n))


def score(docs: DataFrame, model: Linear, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)  # 1 MB whatever the input
    bias, name = model.bias, uuid.uuid4().hex

    def scored(batch: pa.RecordBatch):
        x = batch.to_pydict()
        p = scores(x["text"], weights.value, bias, name)
        yield {"doc_id": x["doc_id"], "held_out": x["held_out"], "score": p, "predicted": (p >= threshold).astype("i4")}

    source = docs.select("doc_id", held_out().alias("held_out"), "text")
    return mapped(source, scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **bounds) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 from the threshold on).

    Null and empty texts have no features and get the score of the bias. Without labels of toxic documents the
    model knows nothing and gives low scores. Null labels and labels of unknown documents are left out; rows that
    repeat are scored alike. A null doc_id is not held out and never sampled.
    """
    return score(docs, fit(docs, labels, **bounds), threshold)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **bounds) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns; nothing is shuffled."""
    model = fit(docs, labels, **bounds)
    weights, bias, name = docs.sparkSession.sparkContext.broadcast(model.weights), model.bias, uuid.uuid4().hex
    at = docs.columns.index("text")

    def kept(batches):
        for batch in batches:
            p = scores(batch.column(at).to_pylist(), weights.value, bias, name)
            yield batch.filter(pa.array(p < threshold))

    return small_batches(docs).mapInArrow(tidy(kept), docs.schema)
