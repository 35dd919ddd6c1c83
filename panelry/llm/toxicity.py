"""Toxicity by a factorization machine over hashed terms.

The score is linear in the terms a text holds plus the inner products of all pairs' factors, so that pairs
weigh what no single term shows. Terms are words and word beginnings, for languages that inflect. Only terms that tell
the labels apart have weights; every term of at least two sampled texts has factors, since a pair may tell where its
terms don't. A text's factors are divided by the root of how many it has, and weights and factors are shrunk to
exactly nothing where they don't help, so long clean texts gather no noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelry.llm.labelled import BITS, SAMPLE_DOCS, fitted, logistic, scored, training_sample
from panelry.llm.text_arrays import NON_LETTERS, Hasher, buffers, slices, word_spans

FACTORS, EPOCHS, RATE = 4, 8, 0.1
#: Shrinkage per step: of a weight towards 0, and of a term's factors as one.
WEIGHT_SHRINK, FACTOR_SHRINK = 2e-4, 2e-4
BEGINNINGS = (4, 5, 6)
#: Least likelihood ratio of a term that gets a weight; chance alone reaches it about once in a thousand terms.
TELLING = 11.0
#: Sampled texts that a term must be in to get factors.
SEEN = 2
LEAST = 0.5
_SHIFT = np.uint64(64 - BITS)


def terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Hashed words and word beginnings (in bytes) of whole texts, in lower case, with the text of each."""
    data, at = buffers(texts)
    for first, last in slices(at):
        piece, own = data[at[first] : at[last]], at[first : last + 1] - at[first]
        starts, ends, counts = word_spans(piece, own, NON_LETTERS)
        hasher = Hasher(piece, lower=True)
        owner = np.repeat(np.arange(last - first), counts)
        owners, found = [owner], [hasher.between(starts, ends) >> _SHIFT]
        for n in BEGINNINGS:
            long = ends - starts > n
            owners.append(owner[long])
            found.append(hasher.between(starts[long], starts[long] + n) >> _SHIFT)
        yield first, last - first, np.concatenate(owners), np.concatenate(found).astype(np.int64)


def tells_labels_apart(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Whether each term's share of texts differs between the labels by more than chance (likelihood ratio)."""
    counts = [np.bincount(np.concatenate([np.empty(0, np.int64), *[x for x, k in zip(rows, y) if k == label]]), minlength=1 << BITS) for label in (0, 1)]
    texts = [(y == label).sum() for label in (0, 1)]
    ratio = np.zeros(1 << BITS)
    for cells, totals in ((counts, texts), ([n - c for n, c in zip(texts, counts)], texts)):
        both = cells[0] + cells[1]
        for c, n in zip(cells, totals):
            expected = both * (n / len(y))
            ratio += 2 * c * np.log(np.where(c > 0, c, 1) / np.where(c > 0, expected, 1))
    return ratio >= TELLING


def fit_machine(rows: list[np.ndarray], y: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights and factors by adaptive gradient steps on the logistic loss, one document at a time, each step followed
    by shrinkage. Without both labels the score is constant."""
    size = 1 << BITS
    rng = np.random.default_rng(seed)
    w, v = np.zeros(size), rng.normal(0, 0.01, (size, FACTORS))
    g_w, g_v, bias, g_bias = np.full(size, 1e-8), np.full(size, 1e-8), 0.0, 1e-8
    share = float(y.mean()) if len(y) else 0.0
    if 0 < share < 1:
        telling = tells_labels_apart(rows, y)
        seen = telling | (np.bincount(np.concatenate(rows), minlength=size) >= SEEN)
        w_rows, v_rows = [x[telling[x]] for x in rows], [x[seen[x]] for x in rows]
        cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        for _ in range(EPOCHS):
            for i in rng.permutation(len(y)):
                x, pairing = w_rows[i], v_rows[i]
                scale = 1 / np.sqrt(max(1, len(pairing)))
                vx = v[pairing] * scale
                total = vx.sum(axis=0)
                z = bias + w[x].sum() + 0.5 * ((total * total).sum() - (vx * vx).sum())
                slope = cost[i] * (logistic(np.array(z)) - y[i])
                g_bias += slope * slope
                bias -= RATE * slope / np.sqrt(g_bias)
                g_w[x] += slope * slope
                step = RATE / np.sqrt(g_w[x])
                new = w[x] - step * slope
                w[x] = np.sign(new) * np.maximum(0, np.abs(new) - step * WEIGHT_SHRINK)
                slopes = slope * scale * (total - vx)
                g_v[pairing] += (slopes * slopes).mean(axis=1)
                step = RATE / np.sqrt(g_v[pairing])[:, None]
                new = v[pairing] - step * slopes
                norm = np.sqrt((new * new).sum(axis=1, keepdims=True))
                v[pairing] = new * np.maximum(0, 1 - step * FACTOR_SHRINK / np.maximum(norm, 1e-12))
    else:
        seen = np.zeros(size, bool)
        bias = 20.0 * (share - 0.5) if len(y) else -10.0
    # Terms whose factors are nothing are held too: they count for the scale.
    held = np.flatnonzero(seen)
    return {"bias": np.array([bias]), "held": held.astype(float), "w": w[held], "v": v[held].ravel()}


def machine_score(model: dict[str, np.ndarray]):
    place = np.full(1 << BITS, -1, np.int64)
    held = model["held"].astype(np.int64)
    place[held] = np.arange(len(held))
    w, v, bias = model["w"], model["v"].reshape(-1, FACTORS), float(model["bias"][0])

    def score(texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), bias)
        for first, n, owner, term in terms(texts):
            at = place[term]
            owner, at = owner[at >= 0], at[at >= 0]
            pairs = np.unique(owner * (len(held) + 1) + at)
            owner, at = pairs // (len(held) + 1), pairs % (len(held) + 1)
            own = slice(first, first + n)
            out[own] += np.bincount(owner, w[at], n)
            many = np.maximum(1, np.bincount(owner, minlength=n))
            for f in range(FACTORS):
                total = np.bincount(owner, v[at, f], n)
                out[own] += 0.5 * (total * total - np.bincount(owner, v[at, f] ** 2, n)) / many
        return logistic(out)

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; the model learns from at most ``sample`` labelled ones.

    Only the text is scored. A null or empty text gets the score of no terms. Repeated rows are scored alike.
    Without labels, or with one label only, all scores are equal. An empty table gives no rows.
    """
    model = fitted(training_sample(docs, labels, "toxic", sample), terms, fit_machine) or fit_machine([], np.empty(0))
    return scored(docs, machine_score(model), LEAST)
