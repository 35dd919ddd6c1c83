"""Mixing sources to target weights: a subset-sum fit over counts of document lengths.

Each source's target is met by whole passes over the source plus a subset of its documents. The subset is
fitted on how many documents of each exact length there are: an even share of every length, then the longest
that fit, then a bounded-knapsack program for the last words, then exchanges of documents of any length for what
is still open. Seeded numbers choose the documents of a length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelry.llm.shared import numbered, saved, unused

#: The budget, in words, that the knapsack program resolves exactly.
REACH = 1 << 15
#: Documents whose exchange is searched as a whole: half of them give a table of 32,768 sums.
EXCHANGED = 30
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of the text; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float = 2.0) -> DataFrame:
    """One row per source: (source, source_no, source_size, target). ``sizes`` holds source and size.

    Sources by code point, null last, take the weights in turn. A target stops at ``most`` times the source's
    size, and what is over goes to the others by weight. With sources by cap per weight, level i is
    the height at which sources before i stop and the others share the rest; the highest level is the true one.
    Works on one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_no") % len(weights) + 1)
    sources = (
        per_source.withColumn("source_no", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
    )
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    levels = sources.withColumn("level", (budget - before) / after)
    height = F.max("level").over(everything)
    return levels.withColumn("height", height).select(
        "source", "source_no", "source_size", F.least("cap", F.col("weight") * F.col("height")).alias("target")
    )


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: float, reach: int = REACH) -> np.ndarray:
    """How many documents of each length to take so that their words come near ``budget``.

    An even share of every length goes first, then the longest that fit until at most ``reach`` words are
    open, then a bounded-knapsack program over the open words picks the sum nearest to them. What is still open, as
    where all documents left are longer than that, ``exchange`` brings down.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if total <= 0 or budget <= 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    take = np.floor(counts * (budget / total)).astype(np.int64)
    rest = int(round(budget)) - int((take * lengths).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if rest <= reach:
            break
        if lengths[i] > 0:
            n = min(counts[i] - take[i], rest // lengths[i])
            take[i] += n
            rest -= n * int(lengths[i])
    open_words = int(min(max(rest, 0), reach))
    limit = 2 * open_words
    parent = np.full(limit + 1, -1, np.int64)
    parent[0] = 0
    parts: list[tuple[int, int, int]] = [(0, 0, 0)]
    for i in order[::-1]:
        length, left = int(lengths[i]), int(counts[i] - take[i])
        if length == 0 or left == 0:
            continue
        if length > limit or parent[open_words] >= 0:
            break
        left, size = min(left, limit // length), 1
        while left:
            n = min(size, left)
            step = n * length
            if step <= limit:
                fresh = np.flatnonzero((parent[step:] < 0) & (parent[:-step] >= 0)) + step
                parts.append((i, n, step))
                parent[fresh] = len(parts) - 1
            left -= n
            size *= 2
    reached = np.flatnonzero(parent >= 0)
    at = int(reached[np.argmin(np.abs(reached - open_words))])
    while at:
        i, n, step = parts[parent[at]]
        take[i] += n
        at -= step
    return exchange(lengths, counts, take, budget)


def exchange(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, budget: float) -> np.ndarray:
    """Take documents or give some back while that brings the words nearer to ``budget``.

    First the best of one taken, one given back, or one for one, as often as it helps. Then ``EXCHANGED`` documents
    are searched for the best of all their subsets; up to so many documents the result is exact.
    """
    take, used = take.copy(), np.flatnonzero(lengths > 0)
    miss = lambda: budget - float((take * lengths).sum())
    while abs(miss()) >= 1:
        more, less = used[take[used] < counts[used]], used[take[used] > 0]
        up, down = np.append(0, lengths[more]), np.append(0, lengths[less])
        by_size = np.argsort(down, kind="stable")
        want = up - miss()
        near = np.clip(np.searchsorted(down[by_size], want)[:, None] + np.array([-1, 0]), 0, len(down) - 1)
        error = np.abs(down[by_size][near] - want[:, None])
        a, b = np.unravel_index(int(np.argmin(error)), error.shape)
        if error[a, b] >= abs(miss()):
            break
        gives = by_size[near[a, b]]
        if a:
            take[more[a - 1]] += 1
        if gives:
            take[less[gives - 1]] -= 1
    if abs(miss()) < 1:
        return take
    # Rounds over the lengths until enough documents are in the pool, a free and a taken one of each.
    pool: list[tuple[int, int]] = []
    free, taken = counts[used] - take[used], take[used].copy()
    spread = used[np.unique(np.linspace(0, max(0, len(used) - 1), EXCHANGED).astype(int))] if len(used) else used
    for turn in range(EXCHANGED):
        for i in spread:
            k = int(np.searchsorted(used, i))
            pool += [(int(i), sign) for sign, left in ((1, free[k]), (-1, taken[k])) if left > turn]
        if len(pool) >= EXCHANGED:
            break
    pool = pool[:EXCHANGED]

    def sums(part: list[tuple[int, int]]) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for i, sign in part:
            out = np.concatenate((out, out + sign * lengths[i]))
        return out

    half = len(pool) // 2
    left, right = sums(pool[:half]), sums(pool[half:])
    by_size = np.argsort(right, kind="stable")
    want = miss() - left
    near = np.clip(np.searchsorted(right[by_size], want)[:, None] + np.array([-1, 0]), 0, len(right) - 1)
    error = np.abs(right[by_size][near] - want[:, None])
    a, b = np.unravel_index(int(np.argmin(error)), error.shape)
    if error[a, b] < abs(miss()):
        for mask, part in ((int(a), pool[:half]), (int(by_size[near[a, b]]), pool[half:])):
            for k, (i, sign) in enumerate(part):
                take[i] += sign * (mask >> k & 1)
    return take


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, seed: int = 2026, reach: int = REACH, carry: Sequence[str] = ()
) -> DataFrame:
    """doc_id, size, source, source_size, target, the words taken and the times of every document, repeats counted.

    A document is taken whole, once more or once less than the passes over its source say. A null or empty text has size 0
    and nothing taken; null sources form one source. Repeated rows are documents of their own. Which of several
    equal rows is taken once more is not defined; they differ in nothing else. An empty table gives no rows.
    ``carry`` names further columns to return.
    """
    sizes = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *carry), "sizes")
    rows = sizes.count()
    targets = saved(source_targets(sizes, weights, share), "targets")
    joined = sizes.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        "s.doc_id", "s.source", "s.size", "t.source_no", "t.source_size", "t.target", *[f"s.{c}" for c in carry]
    )
    counts = joined.groupBy("source_no", "size").agg(
        F.count(F.lit(1)).alias("n"), F.first("source_size").alias("source_size"), F.first("target").alias("target")
    )

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        passes = int(target // size) if size else 0
        extra = fit_counts(rows["size"].to_numpy(), rows["n"].to_numpy(), target - passes * size, reach)
        return pd.DataFrame({"source_no": rows["source_no"], "size": rows["size"], "passes": passes, "extra": extra})

    fitted = saved(counts.groupBy("source_no").applyInPandas(fit, "source_no int, size long, passes int, extra long"), "fit")
    drawn = numbered(joined, ["source_no", "size"], [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")], rows, "draw")
    times = F.col("passes") + F.when(F.col("draw") < F.col("extra"), 1).otherwise(0)
    return drawn.join(fitted, ["source_no", "size"]).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"), times.alias("times"), *carry
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """The documents of the mix with all their columns, as many times as the mix takes each."""
    row, left, turn = (unused(docs, name) for name in ("_row", "_times", "_turn"))
    # Rows alike in id, source and text are alike for the mix: together they get what it takes of all of them.
    alike = F.concat_ws("-", F.hex(F.xxhash64("doc_id", "source", "text")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    marked = docs.withColumn(row, alike)
    times = mix_sources(marked, weights, share, carry=[row]).groupBy(row).agg(F.sum("times").cast("int").alias(left))
    taken = marked.dropDuplicates([row]).join(times.where(F.col(left) > 0), row)
    return taken.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(left)))).select(*docs.columns)
