"""Exact top-k search by exhaustive term-at-a-time accumulation over integer-weighted sparse vectors.

A block of candidates is turned into postings: for each term, who holds it and with what weight. Each term of
each query of a query block then scatters its weight times the postings into dense arrays of scores, from
which the k highest are selected by partition. Every block of queries meets every block of candidates in
a task of its own; the selections of all blocks are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

CANDIDATE_ROWS, QUERY_ROWS = 8192, 512
#: Scores held at once, as queries times candidates.
_SCORES = 1 << 20
_BLOCK = "block int, ids binary, sizes binary, weights binary"
_FOUND = "query_id long, vec_id long, score long"


def integer_weights(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as long, or null where a component is null or not finite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    unfit = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~F.coalesce(unfit, F.lit(False)), F.transform(doubles, lambda x: F.floor(x * scale)))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(id, w) rows packed into about ``rows / size`` blocks of bytes."""

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        weights = table.column("w").combine_chunks()
        sizes = np.asarray(weights.value_lengths().to_numpy(zero_copy_only=False), np.int32)
        return pa.table(
            {
                "block": pa.array([key[0].as_py()], pa.int32()),
                "ids": pa.array([table.column("id").to_numpy().astype("<i8").tobytes()], pa.binary()),
                "sizes": pa.array([sizes.tobytes()], pa.binary()),
                "weights": pa.array([weights.flatten().to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()),
            }
        )

    return rows.groupBy("block").applyInArrow(pack, _BLOCK)


def _entries(sizes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of every component that is not 0."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(weights)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    held = weights != 0
    return row[held], term[held], weights[held]


def accumulate(query: tuple, candidate: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of every query: query ids, candidate ids and scores. Ties go to the smaller id."""
    q_ids, q_sizes, q_weights = query
    c_ids, c_sizes, c_weights = candidate
    order = np.argsort(c_ids, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    c_ids = c_ids[order]
    row, term, weight = _entries(c_sizes, c_weights)
    by_term = np.argsort(term, kind="stable")
    row, term, weight = place[row[by_term]], term[by_term], weight[by_term]
    cuts = np.searchsorted(term, np.arange(term[-1] + 2 if len(term) else 1))
    q_row, q_term, q_weight = _entries(q_sizes, q_weights)
    step = max(1, _SCORES // max(1, len(c_ids)))
    found: list[tuple] = []
    for first in range(0, len(q_ids), step):
        last = min(first + step, len(q_ids))
        scores = np.zeros((last - first, len(c_ids)), np.int64)
        lo, hi = np.searchsorted(q_row, [first, last])
        mine = np.argsort(q_term[lo:hi], kind="stable") + lo
        for these in np.split(mine, np.flatnonzero(np.diff(q_term[mine])) + 1):
            t = q_term[these[0]] if len(these) else len(cuts)
            if t + 1 >= len(cuts) or cuts[t] == cuts[t + 1]:
                continue
            holders, held = row[cuts[t] : cuts[t + 1]], weight[cuts[t] : cuts[t + 1]]
            added = q_weight[these, None] * held
            queries = q_row[these] - first
            if len(holders) == len(c_ids):  # a term that every candidate holds: no scatter needed
                dense = np.empty_like(added)
                dense[:, holders] = added
                scores[queries] += dense
            else:
                scores[queries[:, None], holders] += added
        for i in range(last - first):
            s, own = scores[i], q_ids[first + i]
            pool = np.flatnonzero(c_ids != own)
            values = s[pool]
            if len(pool) > k:
                bound = np.partition(values, len(values) - k)[len(values) - k]
                kept = np.flatnonzero(values >= bound)
                pool, values = pool[kept], values[kept]
            best = np.lexsort((c_ids[pool], -values))[:k]
            found.append((np.full(len(best), own), c_ids[pool[best]], values[best]))
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query, ties to the smaller id.

    Both inputs have vec_id and embedding. A row is no candidate of a query with its own id. Rows with a null
    id, and vectors that are null or hold a null or non-finite component, take no part; missing terms of shorter
    vectors count as 0. Sums are 64-bit. Repeated rows of one id and vector count once; other columns are not
    read. No queries or no candidates give no rows.
    """
    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long").alias("id"), integer_weights(F.col("embedding"), scale).alias("w"))
        return rows.where("id is not null and w is not null").distinct()

    candidates, asked = usable(vectors), usable(queries)
    n_c = vectors.count() // CANDIDATE_ROWS + 1
    n_q = queries.count() // QUERY_ROWS + 1
    dealt = lambda df, n: df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    c = _blocks(dealt(candidates, n_c), CANDIDATE_ROWS)
    q = _blocks(dealt(asked, n_q), QUERY_ROWS)
    tasks = max(1, n_c * n_q // 2)
    # Each pair of blocks is a row of its own, dealt out by both numbers.
    left = c.select(F.col("block").alias("c"), *[F.col(x).alias(f"c_{x}") for x in ("ids", "sizes", "weights")]).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))
    )
    right = q.select(F.col("block").alias("q"), *[F.col(x).alias(f"q_{x}") for x in ("ids", "sizes", "weights")]).withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)))
    )
    pairs = left.repartition(tasks, "c", "q").join(right.repartition(tasks, "c", "q"), ["c", "q"])
    names = ["q_ids", "q_sizes", "q_weights", "c_ids", "c_sizes", "c_weights"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, w, x, y, v = (
                    np.frombuffer(batch.column(j)[i].as_py(), np.int32 if "sizes" in name else np.int64)
                    for j, name in enumerate(names)
                )
                yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in accumulate((a, b, w), (x, y, v), k)], ["query_id", "vec_id", "score"])

    found = pairs.select(*names).mapInArrow(search, _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
