"""Exact quantiles by distributed selection: narrow the range that holds a rank, then sort only that range.

Every round counts the values per bucket of the ranges that are still too full; what travels is one row per task, rank
and bucket. No task sorts, and none holds, all values of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelry.sources.io import materialize

#: Buckets a range is cut into, and rows of a range that is small enough to count its values one by one.
BUCKETS, SMALL = 256, 50_000


def _inside(df: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values of each rank's range: ``df`` beside the state of its group's ranks."""
    a, b = df.alias("a"), state.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    here = F.col("a._v").between(F.col("b.lo"), F.col("b.hi"))
    joined = a.join(b, [*same, here]) if keys else a.join(b, here)
    return joined.select(*[F.col(f"b.{k}") for k in keys], "b.rank", "b.below", "b.lo", "b.hi", "b.held", "a._v")


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], keys: Sequence[str] = (), buckets: int = BUCKETS, small: int = SMALL,
) -> DataFrame:
    """(keys, probability, value) of each group, interpolated between neighbouring ranks as ``percentile`` does.

    Nulls don't count, and a group without values has no rows; null keys are a group of their own. NaN counts as the
    largest value. Each round reads ``df`` once; doubles need at most a few. The state of a rank is one row.
    """
    keys = list(keys)
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = materialize(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")), "sizes").where("n > 0")
    points = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    wanted = sizes.withColumn("probability", points).withColumn("_at", F.col("probability") * (F.col("n") - 1))
    ranks = wanted.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
    state = materialize(
        ranks.select(*keys, F.col("rank").cast("long").alias("rank"), F.lit(0).cast("long").alias("below"), "lo", "hi", F.col("n").alias("held")).distinct(), "ranks"
    )
    wide = (F.col("held") > small) & (F.col("lo") < F.col("hi"))
    while not state.where(wide).isEmpty():
        share = (F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        bucket = F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")
        counts = _inside(values, state.where(wide), keys).groupBy(*keys, "rank", "below", bucket.alias("_b")).agg(
            F.count(F.lit(1)).alias("held"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
        )
        upto = F.sum("held").over(Window.partitionBy(*keys, "rank").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        placed = counts.withColumn("_upto", upto + F.col("below"))
        hit = placed.where((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("held") <= F.col("rank")))
        narrowed = hit.select(*keys, "rank", (F.col("_upto") - F.col("held")).alias("below"), "lo", "hi", "held")
        state = materialize(state.where(~wide).unionByName(narrowed), "ranks")
    counts = _inside(values, state.where("lo < hi"), keys).groupBy(*keys, "rank", "below", "_v").agg(F.count(F.lit(1)).alias("held"))
    upto = F.sum("held").over(Window.partitionBy(*keys, "rank").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("below")
    picked = counts.withColumn("_upto", upto).where((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("held") <= F.col("rank")))
    found = state.where("not (lo < hi)").select(*keys, "rank", F.col("lo").alias("_v")).unionByName(picked.select(*keys, "rank", "_v"))
    a, b = wanted.withColumns({"_low": F.floor("_at"), "_high": F.ceil("_at")}).alias("a"), found.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = a.join(b, [*same, F.col("b.rank").isin(F.col("a._low"), F.col("a._high"))])
    ends = both.groupBy(*[F.col(f"a.{k}") for k in keys], "a.probability", "a._at", "a._low").agg(F.min("b._v").alias("_x"), F.max("b._v").alias("_y"))
    return ends.select(*keys, "probability", (F.col("_x") + (F.col("_at") - F.col("_low")) * (F.col("_y") - F.col("_x"))).alias("value"))
