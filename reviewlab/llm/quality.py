"""Quality classifier by positive-unlabelled learning (operator 1).

Trusted positives are documents labelled as good, the unlabelled set is all web
text, good or not. With a linear score g(x), logistic loss and class prior pi,
the unbiased risk of a classifier that has seen no negatives is

    pi E_p[loss(g)] + ( E_u[loss(-g)] - pi E_p[loss(-g)] )

The bracket is the risk on negatives, which can't be below zero; where an
estimate is, the model fits noise. So Newton steps minimise the whole, and one
that would make the bracket negative is turned along the edge where it is zero:
that is where the non-negative estimator's steps, against the risk above the
edge and up the bracket's gradient below, settle too. A negative bracket costs
``CLIFF`` times its size, so that no step is accepted that gains by it.

Features are counts of a text's bytes and words as shares of its length: kinds
of characters, word lengths, repeated words, bigrams and lines, casing and
punctuation. E_u is over all documents: each step sums gradients and second
derivatives where the rows are, and only sums of the model's size travel.
Positives are at most ``SAMPLE`` labelled documents.

The class prior is estimated from positives and unlabelled text alone, so no
negative need be labelled. A first score is fitted with one half of the
positives; of any region of scores, the share of all documents in it over the
share of the other half's positives is at least the prior, and close to it
where next to no negatives lie. So the prior is that ratio over the best-scored
region, of the size at which the ratio and its sampling error are together
least. Scores of all documents are counted in a histogram of ``BINS`` bins, in
one aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import Words, labelled_sample, mix, per_text, saved, sums, word_chunks

#: labelled documents of each class, about
SAMPLE = 50_000
STEPS, RIDGE, CLIFF = 40, 0.03, 10.0
#: bins of the scores, and the odds of an error beyond the margin that is allowed for
BINS, DELTA = 1024, 0.1
_BYTE_KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:", b"!?", b"|", b"#$%&*@^~_=+<>\\/", b"\"'()[]{}-", b"\n"]
FEATURES = 2 * len(_BYTE_KINDS) + 16
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _distinct(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each text."""
    key = mix(values + text.astype(np.uint64) * _STEP)
    _, at = np.unique(key, return_index=True)
    return np.bincount(text[at], minlength=n)


def text_features(w: Words) -> np.ndarray:
    """(texts, FEATURES) of the texts of a chunk; a text without words is all
    zeros but for its length."""
    n_bytes = np.diff(w.offsets).astype(float)
    n_words = np.diff(w.bounds).astype(float)
    texts = len(n_bytes)
    cols, size = [], np.maximum(n_bytes, 1)
    for kind in _BYTE_KINDS:
        lut = np.zeros(256)
        lut[list(kind)] = 1
        share = sums(lut[w.buf], w.offsets) / size
        cols += [share, np.sqrt(share)]
    other = np.zeros(256)
    other[128:] = 1
    cols.append(sums(other[w.buf], w.offsets) / size)
    words, size = np.maximum(n_words, 1), (w.end - w.start).astype(float)
    text = per_text(w.bounds)
    mean = sums(size, w.bounds) / words
    cols += [mean / 10, np.sqrt(np.maximum(sums(size ** 2, w.bounds) / words - mean ** 2, 0)) / 10]
    kinds = _distinct(w.hash, text, texts) if len(text) else np.zeros(texts)
    cols += [kinds / words, np.log1p(kinds) / np.log1p(words)]
    same = np.zeros(len(w.hash))
    pair = np.zeros(0, np.uint64)
    if len(w.hash) > 1:
        inside = text[1:] == text[:-1]
        same[1:] = (w.hash[1:] == w.hash[:-1]) & inside
        pair = mix(w.hash[:-1] * _STEP + w.hash[1:])[inside]
    cols.append(sums(same, w.bounds) / words)
    pairs = np.maximum(n_words - 1, 1)
    distinct = _distinct(pair, text[1:][inside], texts) if len(pair) else np.zeros(texts)
    cols.append(np.where(n_words > 1, 1 - distinct / pairs, 0))
    first, last = w.buf[w.start] if len(w.start) else w.buf[:0], w.buf[w.end - 1] if len(w.end) else w.buf[:0]
    upper = (first >= 65) & (first <= 90)
    cols.append(sums(upper.astype(float), w.bounds) / words)
    cols.append(sums(np.isin(last, np.frombuffer(b".!?", np.uint8)).astype(float), w.bounds) / words)
    cols.append(sums(np.isin(last, np.frombuffer(b"#$%&*@^~|!", np.uint8)).astype(float), w.bounds) / words)
    cols.append(sums((size == 1).astype(float), w.bounds) / words)
    cols.append(sums((size > 25).astype(float), w.bounds) / words)
    cols += [np.log1p(n_words) / 10, (n_words < 5).astype(float), (n_words == 0).astype(float)]
    lines = np.zeros(len(w.buf))
    lines[w.buf == 10] = 1
    cols.append(np.log1p(words / (sums(lines, w.offsets) + 1)) / 10)
    out = np.stack(cols, 1)
    assert out.shape[1] == FEATURES, out.shape
    return out


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of each row of ``docs`` (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in word_chunks(b.column("text")):
                x = text_features(w)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(w.first, len(x)), flat], ["doc_id", "x"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, x array<double>")


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.asarray(b.column("x").flatten(), np.float64).reshape(b.num_rows, -1)


def _summed(table: DataFrame, of: object) -> np.ndarray:
    """Sum over all rows of a vector that ``of`` makes of each batch's matrix;
    one vector a task, summed by Spark cell by cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                v = of(_matrix(b))
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["cell", "v"])

    rows = table.select("x").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(rows.num_rows)
    out[rows.column("cell").to_numpy()] = rows.column("v").to_numpy()
    return out


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])


def fit_nnpu(unlabelled: DataFrame, positives: np.ndarray, prior: float, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the constant last, means, scales) of the linear score of
    least non-negative risk. ``unlabelled`` has x; a job for each step."""
    m = _summed(unlabelled, lambda x: np.concatenate([[len(x)], x.sum(0), (x ** 2).sum(0)]))
    n, d = m[0], FEATURES
    mean = m[1:d + 1] / n
    scale = np.sqrt(np.maximum(m[d + 1:] / n - mean ** 2, 0)) + 1e-3
    p = _design(positives, mean, scale)
    w = np.zeros(d + 1)
    w[-1] = np.log(prior / (1 - prior))
    penalty = np.full(d + 1, RIDGE)
    penalty[-1] = 0

    def parts(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """E_u of loss(-g), its gradient and second derivative."""
        def of(x: np.ndarray) -> np.ndarray:
            z = _design(x, mean, scale)
            g = np.clip(z @ w, -30, 30)
            s = 1 / (1 + np.exp(-g))
            return np.concatenate([[np.logaddexp(0, g).sum()], z.T @ s, ((z * (s * (1 - s))[:, None]).T @ z).ravel()])

        v = _summed(unlabelled, of) / n
        return v[0], v[1:d + 2], v[d + 2:].reshape(d + 1, d + 1)

    best, at, rate, step = np.inf, w, 1.0, 0 * w
    for _ in range(steps):
        u_risk, u_grad, u_second = parts(w)
        g = np.clip(p @ w, -30, 30)
        s = 1 / (1 + np.exp(-g))
        negative = u_risk - prior * np.logaddexp(0, g).mean()
        risk = prior * np.logaddexp(0, -g).mean() + negative + 0.5 * (penalty * w ** 2).sum() + CLIFF * max(0.0, -negative)
        if risk > best - 1e-7:
            if rate < 1e-3 or risk <= best + 1e-7:
                break
            rate /= 4  # a step too long: go back and take a shorter one
            w = at + rate * step
            continue
        best, at, rate = risk, w, min(1.0, rate * 2)
        gradient = u_grad - prior * p.mean(0) + penalty * w
        inward = u_grad - prior * (p * s[:, None]).mean(0)  # gradient of the risk on negatives
        step, turn = -np.linalg.solve(u_second + np.diag(penalty + 1e-6), np.column_stack([gradient, -inward])).T
        reached = negative + inward @ step
        if reached < 0:  # go along the edge where the risk on negatives is zero
            step = step - reached / max(1e-12, inward @ turn) * turn
        step *= min(1.0, 10 / max(np.linalg.norm(step), 1e-9))
        w = at + rate * step
    return at, mean, scale


def _histogram(g: np.ndarray) -> np.ndarray:
    return np.bincount(np.clip((g + 30) * (BINS / 60), 0, BINS - 1).astype(int), minlength=BINS).astype(float)


def mixture_prior(positives: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from histograms of both over
    the same bins of a score, the best last; kept off 0 and 1."""
    n_p, n_u = positives.sum(), unlabelled.sum()
    p, u = (np.cumsum(h[::-1]) for h in (positives, unlabelled))
    p, u = p / max(n_p, 1), u / max(n_u, 1)
    some = p > 0
    if not some.any():
        return 0.5
    p, u = p[some], u[some]
    error = np.sqrt(np.log(4 / DELTA) / 2) * (1 / np.sqrt(n_p) + 1 / np.sqrt(n_u))
    best = np.argmin((u + error) / p)
    return float(min(0.99, max(0.01, u[best] / p[best])))


def class_prior(table: DataFrame, positives: np.ndarray) -> float:
    """Estimated share of positives among the rows of ``table`` (x)."""
    if len(positives) < 4:  # too few to part
        return 0.5
    learn, held = positives[::2], positives[1::2]
    w, mean, scale = fit_nnpu(table, learn, 0.5)
    g = lambda x: np.clip(_design(x, mean, scale) @ w, -30, 30)
    return mixture_prior(_histogram(g(held)), _summed(table, lambda x: _histogram(g(x))))


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text), learnt from the
    rows of ``labels`` (doc_id, quality) for which ``learn`` holds.

    Score is in 0..1, higher for good. Null and empty texts are scored as texts
    of no words. Repeated rows are scored each; a null doc_id is scored too.
    Without learnable positives among the documents every score is a half.
    Labels of the other class are not used. Columns other than doc_id and text are not looked
    at. No rows: no result."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    chosen = saved(labelled_sample(ids, "quality", learn, sample), "sample")
    table = saved(feature_table(docs), "features")
    trusted = F.broadcast(chosen.where("y = 1").select("doc_id"))  # SAMPLE rows at most, about
    good = table.join(trusted, "doc_id").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").select("x").toArrow()
    if not good.num_rows:
        return table.select("doc_id", F.lit(0.5).alias("score"))
    positives = np.asarray(good.column("x").combine_chunks().flatten(), np.float64).reshape(good.num_rows, -1)
    w, mean, scale = fit_nnpu(table, positives, class_prior(table, positives))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = np.clip(_design(_matrix(b), mean, scale) @ w, -30, 30)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-g)))], ["doc_id", "score"])

    return table.mapInArrow(score, "doc_id long, score double")
