"""Trees grown in one job against a plain implementation, and the same trees from one task and from several."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelry.operators import tree_growing as tg

SETTINGS = tg.Settings(trees=6, depth=3, least_rows=5, step=0.3, least_gain=0.0, share=1.0, seed=7)


def table(rng, n=400):
    """y, a hash, and three inputs: two numbers of few values and a 0/1 one."""
    x = np.column_stack([rng.integers(0, 9, n), rng.integers(0, 5, n) / 4, rng.integers(0, 2, n)]).astype(float)
    y = x[:, 0] * 2 + np.where(x[:, 2] == 1, 7.0, 0.0) * (x[:, 1] > 0.5) + rng.normal(size=n)
    return y, rng.integers(-(2**62), 2**62, n), x


def frame(spark, y, key, x):
    return spark.createDataFrame([(float(a), int(k), [float(v) for v in r]) for a, k, r in zip(y, key, x)], "y double, key long, x array<double>")


def plain(y, x, s):
    """Predictions of boosted trees by trying every value of every input as a threshold."""
    guess = np.zeros(len(y))
    for tree in range(s.trees):
        pull, value = y - guess, np.zeros(len(y))

        def grow(rows, depth):
            best = (1e-12, None)
            if depth < s.depth:
                for f in range(x.shape[1]):
                    for t in np.unique(x[:, f]):
                        left = rows[x[rows, f] <= t]
                        right = rows[x[rows, f] > t]
                        if min(len(left), len(right)) < s.least_rows:
                            continue
                        gain = pull[rows].var() - (len(left) * pull[left].var() + len(right) * pull[right].var()) / len(rows)
                        if gain > best[0] + 1e-9:
                            best = (gain, (left, right))
            if best[1] is None:
                value[rows] = pull[rows].mean()
            else:
                for part in best[1]:
                    grow(part, depth + 1)

        grow(np.arange(len(y)), 0)
        guess += value if tree == 0 else s.step * value
    return guess


def predicted(nodes, x, s):
    trees = {}
    for r in nodes:
        trees.setdefault(r.tree, {})[r.id] = r
    out = np.zeros(len(x))
    for number, tree in trees.items():
        for i, row in enumerate(x):
            node = tree[0]
            while node.left >= 0:
                node = tree[node.left if row[node.feature] <= node.threshold else node.right]
            out[i] += node.prediction * (1.0 if number == 0 else s.step)
    return out


def test_trees_equal_a_plain_search(spark):
    y, key, x = table(np.random.default_rng(5))
    nodes = tg.grow_trees(frame(spark, y, key, x), 3, [2], SETTINGS, tasks=1).collect()
    assert {r.tree for r in nodes} == set(range(6)) and all(r.rows >= 5 for r in nodes)
    assert predicted(nodes, x, SETTINGS) == pytest.approx(plain(y, x, SETTINGS), abs=1e-6)


def test_several_tasks_grow_the_same_trees(spark):
    y, key, x = table(np.random.default_rng(6), 900)
    rows = frame(spark, y, key, x)
    drawn = tg.Settings(**{**SETTINGS.__dict__, "share": 0.8})
    one, many = (tg.grow_trees(rows, 3, [2], drawn, tasks=t).collect() for t in (1, 3))
    again = tg.grow_trees(rows.orderBy(F.rand(1)), 3, [2], drawn, tasks=3).collect()
    assert sorted(many) == sorted(again)
    assert [(r.tree, r.id, r.feature, r.threshold, r.rows) for r in sorted(one)] == [(r.tree, r.id, r.feature, r.threshold, r.rows) for r in sorted(many)]
    assert 0.7 * 900 < one[0].rows < 0.9 * 900


def test_a_task_without_rows_takes_part():
    held = tg.Rows(iter([]), {0: np.array([0.5])}, [1])
    sums = held.sums(np.empty(0, np.int64), 2, np.empty(0), True)
    assert sums.shape == (6 + 4 * tg.BINS + 4,) and not sums.any()


def test_one_value_grows_single_leaves():
    batch = pa.RecordBatch.from_arrays([pa.array([4.0] * 20), pa.array(range(20)), pa.array([[1.0, 0.0]] * 20)], ["y", "key", "x"])
    rows = tg.Rows(iter([batch]), {0: np.array([1.0])}, [1])
    trees = list(tg._grow(rows, {0: np.array([1.0])}, SETTINGS, lambda parts: parts))
    assert [len(t) for t in trees] == [1] * 6 and trees[0][0][2] == 4.0 and trees[1][0][2] == 0.0
