"""Quality by Naive Bayes support vectors: n-gram indicators scaled by log-count ratios, then a linear hinge model.

The n-grams are of word shapes: case, length, the marks around a word, and whether it repeats a word just
before. Shapes carry over to words and languages that training never saw. The hinge loss is minimized
by dual coordinate descent, and a sigmoid turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelry.llm.labelled import BITS, SAMPLE_DOCS, fitted, logistic, score_column, scored, training_sample
from panelry.llm.text_arrays import Hasher, buffers, mix, runs, slices, word_spans

GRAMS, SMOOTHING, COST, EPOCHS, FOLDS = 3, 1.0, 1.0, 30, 4
LEAST = 0.3
_SHIFT = np.uint64(64 - BITS)
_U = np.uint64
_KIND = np.zeros(256, np.uint8)  # 0 mark, 1 lower, 2 upper, 3 digit, 4 part of a multi-byte character
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_LENGTHS = np.array([3, 6, 10, 16, 32, 64])


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A number for the shape of each word."""
    kind = _KIND[data]
    sums = [np.concatenate(([0], np.cumsum(kind == k))) for k in range(4)]
    marks, lower, upper, digits = (s[ends] - s[starts] for s in sums)
    first, last = data[starts], data[ends - 1]
    shape = np.searchsorted(_LENGTHS, ends - starts, side="right").astype(np.uint64)
    for part, base in (
        (np.minimum(lower, 1), 2), (np.minimum(upper, 2), 3), (np.minimum(digits, 2), 3), (np.minimum(marks, 3), 4),
        (np.where(_KIND[first] == 0, first, 0), 256), (np.where(_KIND[last] == 0, last, 0), 256),
    ):
        shape = shape * _U(base) + part.astype(np.uint64)
    word = Hasher(data, lower=True).between(starts, ends)
    place = runs(counts)
    for back in (1, 2):
        same = np.zeros(len(word), bool)
        same[back:] = (word[back:] == word[:-back]) & (place[back:] >= back)
        shape = shape * _U(2) + same
    return mix(shape)


def shape_grams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Hashed runs of one to three word shapes of whole texts, with the text of each."""
    data, at = buffers(texts)
    for first, last in slices(at):
        piece, own = data[at[first] : at[last]], at[first : last + 1] - at[first]
        starts, ends, counts = word_spans(piece, own)
        owner, place = np.repeat(np.arange(last - first), counts), runs(counts)
        shape = shapes(piece, starts, ends, counts) if len(starts) else np.empty(0, np.uint64)
        owners, found, rolled = [], [], np.zeros(len(shape), np.uint64)
        for n in range(GRAMS):
            rolled = mix(rolled * _U(0x9E3779B97F4A7C15) + shape[n:]) if n == 0 else mix(rolled[: len(shape) - n] * _U(0x9E3779B97F4A7C15) + shape[n:])
            whole = place[n:] >= n
            owners.append(owner[n:][whole])
            found.append(rolled[whole] >> _SHIFT)
        yield first, last - first, np.concatenate(owners), np.concatenate(found).astype(np.int64)


def count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log ratio of each indicator's smoothed share in label 1 to that in label 0."""
    p, q = (np.bincount(np.concatenate([np.empty(0, np.int64), *[x for x, k in zip(rows, y) if k == label]]), minlength=1 << BITS) + SMOOTHING for label in (1, 0))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def hinge_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model, by dual coordinate descent over the documents."""
    sign, w, bias = np.where(y == 1, 1.0, -1.0), np.zeros(1 << BITS), 0.0
    share = (y == 1).mean()
    bound = np.where(y == 1, COST * 0.5 / share, COST * 0.5 / (1 - share))
    alpha, values = np.zeros(len(y)), [scale[x] for x in rows]
    norms = np.array([(v * v).sum() + 1.0 for v in values])
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(y)):
            slope = sign[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), bound[i])
            if new != alpha[i]:
                change = (new - alpha[i]) * sign[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
                w[rows[i]] += change * values[i]
                bias += change
        if moved < 1e-4 * COST:
            break
    return w, bias


def fit_sigmoid(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid from margins that the model did not see, by Newton steps; labels weigh alike."""
    share = (y == 1).mean()
    cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = logistic(a * margin + b)
        g, h = cost * (p - target), cost * p * (1 - p) + 1e-9
        gradient = np.array([(g * margin).sum() + 1e-3 * (a - 1), g.sum()])
        hessian = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (a, b) if np.isfinite([a, b]).all() and a > 0 else (1.0, 0.0)


def fit_support_vectors(rows: list[np.ndarray], y: np.ndarray, seed: int = 6) -> dict[str, np.ndarray]:
    """The scaled weights of all indicators, bias and sigmoid. Without both labels the score is constant."""
    rng = np.random.default_rng(seed)
    if len(y) < 2 * FOLDS or min((y == 1).sum(), (y == 0).sum()) < 2:
        constant = (20.0 * (float(y.mean()) - 0.5)) if len(y) else 0.0
        return {"held": np.empty(0), "w": np.empty(0), "line": np.array([0.0, 1.0, constant])}
    fold, margin = rng.permutation(len(y)) % FOLDS, np.zeros(len(y))
    for f in range(FOLDS):
        train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(np.unique(y[train])) < 2:
            continue
        own = [rows[i] for i in train]
        ratios = count_ratios(own, y[train])
        w, bias = hinge_descent(own, ratios, y[train], rng)
        margin[test] = [(w[rows[i]] @ ratios[rows[i]]) + bias for i in test]
    ratios = count_ratios(rows, y)
    w, bias = hinge_descent(rows, ratios, y, rng)
    w = w * ratios
    held = np.flatnonzero(w)
    return {"held": held.astype(float), "w": w[held], "line": np.array([bias, *fit_sigmoid(margin, y)])}


def support_score(model: dict[str, np.ndarray]):
    weight = np.zeros(1 << BITS)
    weight[model["held"].astype(np.int64)] = model["w"]
    bias, a, b = model["line"]

    def score(texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), bias)
        for first, n, owner, gram in shape_grams(texts):
            pairs = np.unique((owner << BITS) | gram)
            out[first : first + n] += np.bincount(pairs >> BITS, weight[pairs & ((1 << BITS) - 1)], n)
        return logistic(a * out + b)

    return score


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS):
    """The score function of texts, fitted on at most ``sample`` labelled documents."""
    model = fitted(training_sample(docs, labels, "quality", sample), shape_grams, fit_support_vectors)
    return support_score(model or fit_support_vectors([], np.empty(0)))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; the model learns from at most ``sample`` labelled ones.

    Only the text is scored. A null or empty text gets the score of no n-grams. Repeated rows are scored alike.
    Without labels, or with one label only, all scores are equal. An empty table gives no rows.
    """
    return scored(docs, fit_quality(docs, labels, sample), LEAST)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """The rows, with all their columns, whose text scores as good."""
    return docs.where(score_column(fit_quality(docs, labels, sample), F.col("text")) >= LEAST)
