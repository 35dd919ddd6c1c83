"""Stored layouts: bucketed tables, tables by month, and roll-ups that are kept up to date."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelry.sources.io import materialize, read_table, shared_path


def bucketed(df: DataFrame, label: str, keys: Sequence[str], buckets: int = 16) -> DataFrame:
    """``df`` written as a table bucketed and sorted by ``keys`` in the shared folder, and read back.

    Joins and groupings of two such tables on exactly these keys, with the same number of buckets, need no
    exchange. Rows are dealt to buckets before the write, so every bucket is one file.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", shared_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def by_month(df: DataFrame, date: str = "date", label: str = "months") -> DataFrame:
    """``df`` written by month of ``date`` and read back, with the month as partition column ``year_month``."""
    path = shared_path(df.sparkSession, label)
    dated = df.withColumn("year_month", F.trunc(date, "month"))
    dated.write.partitionBy("year_month").parquet(path)
    return df.sparkSession.read.schema(dated.schema).parquet(path)


def between_days(stored: DataFrame, days: DataFrame, date: str = "date") -> DataFrame:
    """The rows of a table ``by_month`` whose day is in ``days`` (one column of that name).

    The months of the days prune the read while the query runs, so the days may come from any query.
    """
    months = days.select(F.trunc(date, "month").alias("year_month")).distinct()
    near = stored.join(F.broadcast(months) if _few(months) else months, "year_month")
    return near.join(days.select(date).distinct(), date, "left_semi").select(*stored.columns)


#: Months that are surely few enough to broadcast: a thousand years.
MANY_MONTHS = 12_000


def _few(months: DataFrame) -> bool:
    return months.limit(MANY_MONTHS + 1).count() <= MANY_MONTHS


class RollUp:
    """Sums per group and month, kept up to date: new lines, late ones too, rewrite only the months they fall in.

    ``sums`` names additive columns and how each comes from the lines. The table lies in ``path``, by ``year_month``.
    """

    def __init__(self, path: str, keys: Sequence[str], sums: dict[str, Column], date: str = "date"):
        self.path, self.keys, self.sums, self.date = path, list(keys), sums, date

    def _summed(self, lines: DataFrame) -> DataFrame:
        dated = lines.withColumn("year_month", F.trunc(self.date, "month")).where("year_month is not null")
        return dated.groupBy("year_month", *self.keys).agg(*[column.alias(name) for name, column in self.sums.items()])

    def create(self, lines: DataFrame) -> None:
        """The first load. Lines without a date are left out."""
        self._write(self._summed(lines))

    def add(self, lines: DataFrame) -> None:
        """Add lines to the months they belong to. A lost executor or a rerun of the write does not count lines twice:
        the new months are complete in the shared folder before the old ones are replaced."""
        spark = lines.sparkSession
        fresh = materialize(self._summed(lines), "fresh")
        months = fresh.select("year_month").distinct()
        old = self.read(spark).join(months, "year_month", "left_semi")
        both = old.unionByName(fresh).groupBy("year_month", *self.keys).agg(*[F.sum(name).alias(name) for name in self.sums])
        self._write(materialize(both, "months"))

    def _write(self, table: DataFrame) -> None:
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year_month").parquet(self.path)

    def read(self, spark) -> DataFrame:
        return read_table(spark, self.path, "parquet")
