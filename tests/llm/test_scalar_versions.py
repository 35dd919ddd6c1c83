"""Shards, the factorization machine and the hinge-loss model against plain scalar versions."""

import struct

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from panelry.llm import quality, sharding, toxicity


def scalar_jump(key, shards):
    """The published loop, one key at a time."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_scalar_loop():
    keys = np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64)
    for shards in (1, 2, 8, 9, 1000):
        assert sharding.jump_hash(keys.copy(), shards).tolist() == [scalar_jump(int(k), shards) for k in keys]


def test_every_document_is_in_its_scalar_shard(spark, documents, odd_documents):
    docs = odd_documents.union(documents([(i, f"text {i}") for i in range(100, 600)]))
    mixed = lambda i: xxhash.xxh64(struct.pack("<q", i or 0), seed=42).intdigest()
    rows = sharding.assign_shards(docs, 8).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.shard, r.grown_shard) == (scalar_jump(mixed(r.doc_id), 8), scalar_jump(mixed(r.doc_id), 9))


def test_machine_score_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words, 8)) for _ in range(80)] + ["", "word1", "never seen"]
    y = np.array([int("word3" in t.split() and "word5" in t.split() or "word7" in t.split()) for t in texts])
    rows = toxicity_rows(texts)
    model = toxicity.fit_machine(rows, y)
    place = {int(t): k for k, t in enumerate(model["held"])}
    v, want = model["v"].reshape(-1, toxicity.FACTORS), []
    for x in rows:
        held = [place[int(t)] for t in x if int(t) in place]
        pairs = sum(float(v[a] @ v[b]) for i, a in enumerate(held) for b in held[i + 1 :])
        want.append(1 / (1 + np.exp(-(model["bias"][0] + sum(model["w"][a] for a in held) + pairs / max(1, len(held))))))
    got = toxicity.machine_score(model)(pa.array(texts))
    assert got == pytest.approx(want) and got[y == 1].mean() > got[y == 0].mean() + 0.2


def toxicity_rows(texts):
    from panelry.llm.labelled import rows_of

    return rows_of(toxicity.terms, pa.array(texts))


def test_hinge_descent_reaches_the_least_objective():
    """The primal objective, against many plain subgradient steps."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(120)]
    y = np.array([int(3 in x or (7 in x and 9 in x) or rng.random() < 0.1) for x in rows])
    scale = quality.count_ratios(rows, y)
    share = (y == 1).mean()
    cost = np.where(y == 1, quality.COST * 0.5 / share, quality.COST * 0.5 / (1 - share))
    x = np.zeros((len(rows), 41))
    for i, r in enumerate(rows):
        x[i, r], x[i, 40] = scale[r], 1.0
    sign = np.where(y == 1, 1.0, -1.0)
    objective = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - sign * (x @ w))).sum()
    w, best = np.zeros(41), np.inf
    for t in range(1, 30_000):
        slope = w - ((cost * sign) * (sign * (x @ w) < 1)) @ x
        w = w - slope / (t + 100)
        best = min(best, objective(w))
    got, bias = quality.hinge_descent(rows, scale, y, np.random.default_rng(4))
    assert objective(np.append(got[:40], bias)) <= 1.02 * best


@pytest.mark.parametrize("label", [0, 1])
def test_one_label_gives_one_score(spark, documents, label):
    docs = documents([(i, f"some text {i % 7}") for i in range(60)])
    labels = spark.createDataFrame([(i, label, label) for i in range(60)], "doc_id long, quality int, toxic int")
    for operator in (toxicity.score_toxicity, quality.score_quality):
        assert {(r.predicted) for r in operator(docs, labels).collect()} == {label}
        assert len({r.score for r in operator(docs, labels).collect()}) == 1
