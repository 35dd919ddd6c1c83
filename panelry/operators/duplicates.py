"""Repeated whole rows, by fingerprints first and whole rows only where fingerprints repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from panelry.operators.filters import rows_maybe_in
from panelry.sources.io import materialize


def fingerprint(df: DataFrame) -> tuple[Column, Column]:
    """Two hashes of 64 bits over all columns, as one struct: a table may have thousands. Hashes pass over nulls, so rows
    that differ by the place of a null share them, as do the rare different rows of one hash; ``duplicate_rows`` tells them apart."""
    whole = F.struct(*[F.col(f"`{name}`") for name in df.columns])
    return F.xxhash64(whole), F.xxhash64(F.lit(0x5F3759DF), whole)


def duplicate_rows(df: DataFrame, prints: Callable[[DataFrame], tuple[Column, Column]] = fingerprint) -> DataFrame:
    """Number of rows that repeat an earlier row in every column.

    Fingerprints are counted first: 16 bytes a row, combined before the shuffle. Only rows whose fingerprint repeats are
    then counted whole, so different rows of one fingerprint are told apart. Reads the table twice.
    """
    one, two = prints(df)
    counts = df.select(one.alias("_one"), two.alias("_two")).groupBy("_one", "_two").count()
    repeated = materialize(counts.where("count > 1").select("_one", "_two"), "repeated")
    marked = rows_maybe_in(df.withColumns({"_one": one, "_two": two}), F.col("_one"), repeated, F.col("_one"))
    suspects = marked.join(repeated, ["_one", "_two"], "left_semi")
    row = F.struct(*[F.col(f"`{name}`") for name in df.columns])
    whole = suspects.select(row.alias("_row")).groupBy("_row").agg(F.count(F.lit(1)).alias("_copies"))
    return whole.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))
