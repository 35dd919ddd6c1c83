"""Table access, gapless numbering and connected components for the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelry.sources.io import materialize

#: Rows of a numbering bucket, on average.
BUCKET_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    return materialize(df, label)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def numbered(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], rows: int, name: str = "rank"
) -> DataFrame:
    """Number the rows of each group from 0 without gaps, with no group in one task.

    Rows fall into hash buckets of ``order``; a bucket is numbered on its own and starts where the buckets
    before it end. ``rows`` is the number of rows of the table. Equal rows get their numbers in any order.
    """
    buckets = rows // BUCKET_ROWS + 1
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*groups, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*groups, "_bucket").orderBy(*order)
    placed = dealt.withColumn("_place", F.row_number().over(inner) - 1)
    a, b = placed.alias("a"), starts.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*groups, "_bucket")]
    number = (F.col("b._start") + F.col("a._place")).cast("long").alias(name)
    return a.join(b, same).select(*[F.col(f"a.{c}") for c in df.columns], number)


#: Bits of the filter of ``among``: its size is fixed, so it may go to every task.
FILTER_BITS = 1 << 23


def may_be_among(ids: DataFrame, column: str, bits: int = FILTER_BITS) -> Callable[[Column], Column]:
    """A test of an id column: true for every id among ``ids``, and for few others while the ids are fewer than the bits."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = (
        ids.select(slot(F.col(column)).alias("s")).distinct()
        .groupBy((F.col("s") / 32).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("m"))
        .toPandas()
    )
    bitmap = np.zeros(bits // 32, np.uint32)
    bitmap[words["w"].to_numpy()] = words["m"].to_numpy().astype(np.uint32)

    @F.pandas_udf("boolean")
    def may_hold(slots: pd.Series) -> pd.Series:
        s = slots.to_numpy(np.int64)
        return pd.Series((bitmap[s >> 5] >> (s & 31).astype(np.uint32)) & 1 == 1)

    return lambda c: may_hold(slot(c))


def among(rows: DataFrame, ids: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose id may be among ``ids``, by a bitmap of fixed size: a filter in front of a join.

    It keeps every row that the join needs, and most others away from the shuffle while the ids are fewer than the
    bits; with many more ids than bits it keeps all rows and the join does all the work.
    """
    return rows.where(may_be_among(ids, column, bits)(F.col(column)))


def components(edges: DataFrame) -> DataFrame:
    """The smallest id that each id reaches: (id, component) for every id of the edges (a, b), both long.

    Every round, each vertex hands over to its neighbour of the lowest random priority, and the edges are
    contracted; a round leaves a constant share of a component's vertices, so the rounds grow with the
    logarithm of the component. Each round is written to the shared folder.
    """
    edges = saved(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), "edges")
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    labels, salt = None, 0
    while not edges.isEmpty():
        priority = lambda c, salt=salt: F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("p"), F.col(c).alias("v"))
        both = edges.union(edges.select("b", "a"))
        lowest = both.groupBy("a").agg(F.min(priority("b")).alias("low"))
        heir = F.least(F.col("low"), priority("a"))
        heirs = saved(lowest.select(F.col("a").alias("v"), heir["v"].alias("heir")), "heirs")
        if labels is None:
            labels = heirs.select(F.col("v").alias("id"), F.col("heir").alias("label"))
        else:
            labels = saved(
                labels.join(heirs, labels["label"] == heirs["v"], "left").select("id", F.coalesce("heir", "label").alias("label")),
                "labels",
            )
        left = heirs.select(F.col("v").alias("a"), F.col("heir").alias("x"))
        right = heirs.select(F.col("v").alias("b"), F.col("heir").alias("y"))
        contracted = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = saved(contracted.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        salt += 1
    if labels is None:
        return ids.select("id", F.col("id").alias("component"))
    smallest = labels.groupBy("label").agg(F.min("id").alias("component"))
    return labels.join(smallest, "label").select("id", "component")
