"""Top-k search and the embedding join against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from panelry.llm import embedding_dedup, topk_search

SCHEMA = "vec_id long, embedding array<float>, label int, score string, block string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", "y") for i, v, l in rows], SCHEMA)


def brute_top(rows, queries, k):
    whole = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.setdefault((i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v)))
    out = set()
    for q, w in whole:
        if q in queries:
            scores = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in whole if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    return out


def test_top_k_equals_brute_force_with_ties_nulls_and_ragged_rows(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CANDIDATE_ROWS", 30)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 4)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 4], 0) for i in range(200)]
    rows += [(200, None, 0), (201, [1.0, None], 0), (202, [float("nan")], 0), (203, [float("inf"), 1.0], 0), (None, [1.0], 0)]
    rows += [(204, [], 0), (205, [1.0, -1.0], 1), (206, [0.0] * 6, None), (0, rows[0][1], 0)]
    df = table(spark, rows)
    got = topk_search.top_k(df, df.where("vec_id % 20 = 0"), k=5)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute_top(rows, set(range(0, 220, 20)), 5)


def test_top_k_of_nothing(spark):
    df = table(spark, [])
    assert topk_search.top_k(df, df).collect() == []
    one = table(spark, [(1, [1.0], 0)])
    assert topk_search.top_k(one, one).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 6))
def test_accumulate_is_exact(seed, n, k):
    rng = np.random.default_rng(seed)
    sizes, q_sizes = rng.integers(0, 5, n).astype(np.int32), rng.integers(0, 5, 3).astype(np.int32)
    w, q = rng.integers(-3, 4, sizes.sum()), rng.integers(-3, 4, q_sizes.sum())
    ids, q_ids = rng.permutation(100)[:n].astype(np.int64), rng.permutation(100)[:3].astype(np.int64)
    got = list(zip(*(x.tolist() for x in topk_search.accumulate((q_ids, q_sizes, q), (ids, sizes, w), k))))
    rows = lambda s, x: np.split(x, np.cumsum(s)[:-1])
    want = []
    for i, a in zip(q_ids, rows(q_sizes, q)):
        best = sorted((-int(sum(x * y for x, y in zip(a, b))), int(j)) for j, b in zip(ids, rows(sizes, w)) if j != i)[:k]
        want += [(int(i), j, -s) for s, j in best]
    assert got == want


def brute_links(rows, least):
    links, ids = {}, [i for i, _, _ in rows]
    fit = [v is not None and l is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, l in rows]
    near = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(len(rows)):
            (_, v, l), (_, w, m) = rows[a], rows[b]
            if a != b and fit[a] and fit[b] and l == m and len(v) == len(w):
                x, y = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                    near[a].add(b)
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[a], *(group[b] for b in near[a])]) for a in range(len(rows))]
    for a in range(len(rows)):
        members = [ids[b] for b in range(len(rows)) if group[b] == group[a]]
        links[a] = (ids[a], len(near[a]), None if ids[a] is None else min(m for m in members if m is not None))
    return sorted(map(str, links.values()))


@pytest.mark.parametrize("leaf", [4, 128])
def test_embedding_links_equal_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(embedding_dedup, "INTERVAL_ROWS", 16)
    monkeypatch.setattr(embedding_dedup, "LEAF_ROWS", leaf)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 6))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(0, 0.25, 6)], int(i % 3)) for i in range(150)]
    rows += [(150, rows[0][1], 0), (151, rows[0][1], 0), (152, rows[0][1], 1), (153, rows[0][1], None), (154, None, 0), (155, [0.0] * 6, 0)]
    rows += [(156, [1.0, None], 0), (157, [float("nan")] * 6, 0), (158, [1.0, 2.0], 0), (159, [2.0, 4.0], 0), (160, [], 0), (None, rows[0][1], 0)]
    got = embedding_dedup.near_vectors(table(spark, rows), 0.93).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id)) for r in got) == brute_links(rows, 0.93)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_no_vectors(spark):
    assert embedding_dedup.near_vectors(table(spark, [])).collect() == []


def test_interval_pairs_equal_a_plain_search(spark):
    """Boxes of two labels along a line and of a third in one place: the tree finds the pairs that all pairs would give."""
    rng = random.Random(9)
    rows = []
    for label, dim, at in (("a", 8, lambda i: i / 40), ("b", 8, lambda i: rng.random()), ("b", 3, lambda i: i / 3), ("c", 8, lambda i: 0.5)):
        for i in range(70):
            low = [at(i), *[rng.random() / 5 for _ in range(embedding_dedup.DIRECTIONS - 1)]]
            rows.append((f"{len(rows) // 9:09d}-{i:09d}", label, dim, low, [x + rng.random() / 20 for x in low]))
    boxes = spark.createDataFrame(rows, "interval string, label string, dim int, low array<double>, high array<double>")
    far = lambda p, q: sum(max(0, q[3][k] - p[4][k], p[3][k] - q[4][k]) ** 2 for k in range(embedding_dedup.DIRECTIONS))
    want = sorted((p[0], q[0]) for p in rows for q in rows if p[1:3] == q[1:3] and p[0] <= q[0] and far(p, q) <= 0.01)
    assert sorted(map(tuple, embedding_dedup._interval_pairs(boxes, 0.1).collect())) == want
    assert embedding_dedup._interval_pairs(boxes.limit(0), 0.1).count() == 0
