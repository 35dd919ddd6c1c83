"""Boosted regression trees grown by all tasks together in one Spark job.

Every task of a barrier stage keeps its share of the rows as bins. For each level of a tree the tasks add up their
histograms with ``allGather`` and then choose the same splits, so a fit of any number of trees schedules one job. What is
exchanged depends on nodes, features and bins, never on the rows.
"""

from __future__ import annotations

from base64 import b64decode, b64encode
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

#: Bins of a numeric feature: at most so many thresholds, at quantiles of the training rows.
BINS = 64
#: Rows whose histogram keys are held at once.
CHUNK = 1 << 15

NODE_SCHEMA = (
    "tree int, id int, prediction double, impurity double, rows long, gain double, "
    "left int, right int, feature int, threshold double"
)


@dataclass(frozen=True)
class Settings:
    trees: int
    depth: int
    least_rows: int
    step: float
    least_gain: float
    share: float
    seed: int


def thresholds(rows: DataFrame, numeric: Sequence[int], bins: int = BINS) -> dict[int, np.ndarray]:
    """Ascending thresholds of each numeric feature of the array column ``x``: values at its quantiles, from one aggregate."""
    points = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.get("x", F.lit(i)), points, 10_000).alias(f"f{i}") for i in numeric]).first()
    return {i: np.unique(np.array(found[f"f{i}"] or [], float)) for i in numeric}


def _added(parts: np.ndarray) -> np.ndarray:
    """The sum over all tasks, added in the order of the tasks, so that every task gets the same digits."""
    context = BarrierTaskContext.get()
    if not hasattr(context, "allGather") or len(context.getTaskInfos()) == 1:
        return parts
    said = context.allGather(b64encode(parts.tobytes()).decode())
    total = np.zeros_like(parts)
    for message in said:
        total += np.frombuffer(b64decode(message), parts.dtype).reshape(parts.shape)
    return total


def _drawn(keys: np.ndarray, tree: int, settings: Settings) -> np.ndarray:
    """Which rows a tree sees: by the rows' hashes, so the draw does not depend on who holds a row."""
    h = keys ^ np.uint64((tree * 0x9E3779B97F4A7C15 + settings.seed) % 2**64)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(33))) >> np.uint64(11)).astype(np.float64) / 2.0**53 < settings.share


class Rows:
    """The rows of one task: bins of numeric features, and for 0/1 features the places of the ones."""

    def __init__(self, batches: Iterator[pa.RecordBatch], cuts: dict[int, np.ndarray], binary: Sequence[int]):
        y, keys, bins, ones_row, ones_of, n = [], [], [], [], [], 0
        self.numeric, self.binary = list(cuts), list(binary)
        for batch in batches:
            values = batch.column(2).combine_chunks() if isinstance(batch.column(2), pa.ChunkedArray) else batch.column(2)
            x = values.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y.append(batch.column(0).to_numpy(zero_copy_only=False))
            keys.append(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            bins.append(np.array([np.searchsorted(cuts[i], x[:, i], side="left") for i in self.numeric], np.uint8).reshape(len(cuts), -1))
            row, of = np.nonzero(x[:, self.binary] == 1.0)
            ones_row.append(row + n)
            ones_of.append(of)
            n += batch.num_rows
        self.y = np.concatenate(y) if y else np.empty(0)
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        self.bins = np.concatenate(bins, axis=1) if bins else np.empty((len(cuts), 0), np.uint8)
        self.ones_row = np.concatenate(ones_row).astype(np.int64) if ones_row else np.empty(0, np.int64)
        self.ones_of = np.concatenate(ones_of).astype(np.int64) if ones_of else np.empty(0, np.int64)
        self.has = np.zeros((len(self.binary), len(self.y)), bool)
        self.has[self.ones_of, self.ones_row] = True
        self._base = np.arange(len(self.numeric))[:, None] * BINS

    def sums(self, node: np.ndarray, nodes: int, pull: np.ndarray, binned: bool) -> np.ndarray:
        """Rows and summed residuals of ``nodes`` nodes, as one flat array: per node (with squares), and unless ``binned`` is
        off per node, numeric feature and bin, and per node and 0/1 feature for the ones. Rows of node -1 don't count."""
        where = np.flatnonzero(node >= 0)
        at, r = node[where], pull[where]
        parts = [np.bincount(at, minlength=nodes), np.bincount(at, r, nodes), np.bincount(at, r * r, nodes)]
        if binned:
            size = len(self.numeric) * BINS
            counts, totals = np.zeros(nodes * size), np.zeros(nodes * size)
            for first in range(0, len(where), CHUNK):
                rows = where[first : first + CHUNK]
                key = (self.bins[:, rows] + self._base + node[rows] * size).ravel()
                counts += np.bincount(key, minlength=nodes * size)
                totals += np.bincount(key, np.tile(pull[rows], len(self.numeric)), nodes * size)
            seen = node[self.ones_row] >= 0
            rows, of = self.ones_row[seen], self.ones_of[seen]
            key, width = node[rows] * len(self.binary) + of, nodes * len(self.binary)
            parts += [counts, totals, np.bincount(key, minlength=width), np.bincount(key, pull[rows], width)]
        return np.concatenate([p.astype(float, copy=False) for p in parts])


class Sums:
    """What ``Rows.sums`` added up, by node: totals (3, nodes), bins (2, nodes, numeric, BINS) and ones (2, nodes, binary)."""

    def __init__(self, flat: np.ndarray, nodes: int, numeric: int, binary: int, binned: bool):
        self.totals = flat[: 3 * nodes].reshape(3, nodes)
        cut = 3 * nodes + 2 * nodes * numeric * BINS
        self.bins = flat[3 * nodes : cut].reshape(2, nodes, numeric, BINS) if binned else None
        self.ones = flat[cut:].reshape(2, nodes, binary) if binned else None

    def with_siblings(self, parents: Sums, of: np.ndarray, left_is_held: np.ndarray) -> None:
        """Put beside every node its sibling, which is the parent without it; left nodes come first in a pair."""
        for name in ("totals", "bins", "ones"):
            mine = getattr(self, name)
            if mine is None:
                continue
            other = getattr(parents, name)[:, of] - mine
            held = left_is_held.reshape(1, -1, *[1] * (mine.ndim - 2))
            pair = np.stack([np.where(held, mine, other), np.where(held, other, mine)], axis=2)
            setattr(self, name, pair.reshape(mine.shape[0], -1, *mine.shape[2:]))


def best_splits(sums: Sums, cuts: Sequence[np.ndarray], settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node: the gain of the split that lowers the variance most, its place, and the rows on its left side.

    A place is numeric feature * BINS + bin, or, after all of those, the number of a 0/1 feature. The gain is 0 where no
    split is allowed; ties go to the first place.
    """
    n, s = sums.totals[0][:, None], sums.totals[1][:, None]
    left = np.cumsum(sums.bins, axis=3).reshape(2, len(n), -1)
    zeros = np.stack([n - sums.ones[0], s - sums.ones[1]])
    nl, sl = np.concatenate([left, zeros], axis=2)
    nr, sr = n - nl, s - sl
    used = np.zeros(nl.shape[1], bool)
    for k, c in enumerate(cuts):
        used[k * BINS : k * BINS + len(c)] = True
    used[len(cuts) * BINS :] = True
    with np.errstate(all="ignore"):
        gain = (sl * sl / nl + sr * sr / nr - s * s / n) / n
        gain = np.where(used & (nl >= settings.least_rows) & (nr >= settings.least_rows) & (gain > max(settings.least_gain, 1e-12)), gain, 0.0)
    if not gain.shape[1]:
        return np.zeros(len(n)), np.zeros(len(n), np.int64), np.zeros(len(n))
    place = np.argmax(gain, axis=1)
    every = np.arange(len(n))
    return gain[every, place], place, nl[every, place]


def _grow(rows: Rows, cuts: dict[int, np.ndarray], settings: Settings, add: Callable[[np.ndarray], np.ndarray]) -> Iterator[list[tuple]]:
    """The nodes of one tree after the other. The first tree counts whole, every later one by the step.

    From the second level on only the smaller child of every split is summed up; the other is its parent without it.
    """
    guess = np.zeros(len(rows.y))
    limits = [cuts[i] for i in rows.numeric]
    bins = len(limits) * BINS
    for tree in range(settings.trees):
        pull = rows.y - guess
        drawn = _drawn(rows.keys, tree, settings)
        node = np.zeros(len(rows.y), np.int64)
        value = np.zeros(len(rows.y))
        ids, made, nodes = [0], 1, []
        counted, parents, of, left_is_held = np.zeros(1, np.int64), None, None, None
        for depth in range(settings.depth + 1):
            last = depth == settings.depth
            # counted: the number a node has among those that are summed up, or -1.
            label = np.where(drawn & (node >= 0), counted[node], -1)
            held = int(counted.max()) + 1
            sums = Sums(add(rows.sums(label, held, pull, not last)), held, len(limits), len(rows.binary), not last)
            if parents is not None:
                sums.with_siblings(parents, of, left_is_held)
            n, total, squares = sums.totals
            mean = np.divide(total, n, out=np.zeros(len(n)), where=n > 0)
            spread = np.maximum(np.divide(squares, n, out=np.zeros(len(n)), where=n > 0) - mean * mean, 0.0)
            gain, place, n_left = (np.zeros(len(n)),) * 3 if last else best_splits(sums, limits, settings)
            child = np.full(len(n), -1, np.int64)
            following = []
            for v in range(len(n)):
                if gain[v] > 0:
                    p = int(place[v])
                    numeric = p < bins
                    feature = rows.numeric[p // BINS] if numeric else rows.binary[p - bins]
                    threshold = float(limits[p // BINS][p % BINS]) if numeric else 0.5
                    nodes.append((tree, ids[v], float(mean[v]), float(spread[v]), int(n[v]), float(gain[v]), made, made + 1, feature, threshold))
                    child[v] = len(following)
                    following += [made, made + 1]
                    made += 2
                else:
                    nodes.append((tree, ids[v], float(mean[v]), float(spread[v]), int(n[v]), -1.0, -1, -1, -1, 0.0))
            here = np.flatnonzero(node >= 0)
            at = node[here]
            ends = child[at] < 0
            value[here[ends]] = mean[at[ends]]
            if not following:
                break
            here, at = here[~ends], at[~ends]
            p = place[at]
            numeric = p < bins
            right = np.empty(len(here), bool)
            right[numeric] = rows.bins[p[numeric] // BINS, here[numeric]] > p[numeric] % BINS
            right[~numeric] = rows.has[p[~numeric] - bins, here[~numeric]]
            node = np.full(len(node), -1, np.int64)
            node[here] = child[at] + right
            of = np.flatnonzero(child >= 0)
            left_is_held = n_left[of] <= n[of] - n_left[of]
            counted = np.full(len(following), -1, np.int64)
            counted[2 * np.arange(len(of)) + ~left_is_held] = np.arange(len(of))
            parents, ids = sums, following
        guess += value if tree == 0 else settings.step * value
        yield nodes


def grow_trees(rows: DataFrame, features: int, binary: Sequence[int], settings: Settings, tasks: int) -> DataFrame:
    """The nodes of all trees, fitted to ``rows`` (y double, key long, x array<double> of ``features`` values without nulls).

    ``key`` is a hash of the row; it decides who holds the row and which trees see it, so the same rows give the same
    trees for the same number of tasks. ``binary`` features hold 0 and 1 only. All tasks must be able to run at once, and
    a lost one restarts the stage.
    """
    numeric = [i for i in range(features) if i not in set(binary)]
    cuts, ones = thresholds(rows, numeric) if numeric else {}, list(binary)
    columns = [field.split() for field in NODE_SCHEMA.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Rows(batches, cuts, ones)
        first = tasks == 1 or BarrierTaskContext.get().partitionId() == 0
        for nodes in _grow(held, cuts, settings, (lambda x: x) if tasks == 1 else _added):
            if first:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(v), kinds[kind]) for v, (_, kind) in zip(zip(*nodes), columns)], [name for name, _ in columns]
                )

    dealt = rows.repartition(tasks, "key").sortWithinPartitions("key", "y")
    return dealt.mapInArrow(grow, NODE_SCHEMA, barrier=tasks > 1)


# Ship the growing with the job, so that workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])
