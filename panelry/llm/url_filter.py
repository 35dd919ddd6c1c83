"""URL rules by host and path: a sort-merge range join, in DataFrame operations only.

A host read from its last label makes every rule an interval of keys: the rule's key and all keys it begins.
The rules and the urls are range-partitioned and sorted together; a rule stays on the stack of active rules while its
interval lasts, and intervals either nest or are apart. The sweep of a range carries the stack of the last rule passed,
and starts with the stack that the ranges before it end with, so every rule is in one range only. The first rule of the stack that
still holds is the longest that fits.

A rule with a path also covers subdomains, whose keys lie elsewhere. A url therefore enters the sweep once
for each level of its host, and the longest rule of all levels wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelry.llm.shared import saved

#: Rows of one sorted range, on average, as long as that makes no more than ``MOST_RANGES``.
SWEEP_ROWS, MOST_RANGES = 50_000, 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """Adds host and path of the url; both are empty for a null url or one without ``://``."""
    rest = F.regexp_extract(F.col("url"), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", F.coalesce(lower_ascii(host), F.lit(""))).withColumn(
        "path", F.coalesce(path, F.lit(""))
    )


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table with the stack of each: the rules it is nested in, longest first."""
    given = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string").distinct()
    outer = given.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("verdict").alias("v"))
    nested = (F.col("host") == F.col("h")) & F.col("path").startswith(F.col("p"))
    entry = F.struct(F.length("p").alias("n"), F.col("p").alias("path"), F.col("v").alias("verdict"))
    stacks = given.join(outer, nested).groupBy("host", "path").agg(F.sort_array(F.collect_set(entry), False).alias("stack"))
    return stacks.withColumn("key", _reversed(F.col("host")))


_STACK = "array<struct<n:int,path:string,verdict:string>>"


def _entered(pages: DataFrame) -> DataFrame:
    """A row per url and level of its host."""
    urls = with_host_and_path(pages.select("page_id", "url")).select("page_id", "host", "path", F.monotonically_increasing_id().alias("row"))
    labels = F.split("host", r"\.", -1)
    levels = F.transform(
        F.sequence(F.lit(1), F.size("labels")),
        lambda i: F.array_join(F.slice(F.col("labels"), F.size("labels") - i + 1, i), "."),
    )
    return urls.withColumn("labels", labels).select("page_id", "host", "path", "row", F.explode(levels).alias("level"))


def _ranged(pages: DataFrame, rules: Sequence[tuple[str, str, str]], sweep_rows: int) -> DataFrame:
    """Urls (kind 1) and rules (kind 0) in ranges of their common order. A host with many urls is cut by path and row."""
    urls = _entered(pages).select(
        "page_id", "host", "path", "row", "level", _reversed(F.col("level")).alias("key"), F.lit(1).alias("kind"),
        F.lit(None).cast(_STACK).alias("stack"),
    )
    starts = rule_table(pages.sparkSession, rules).select(
        F.lit(None).cast("long").alias("page_id"), "host", "path", F.lit(None).cast("long").alias("row"),
        F.col("host").alias("level"), "key", F.lit(0).alias("kind"), "stack",
    )
    # A url has three or four levels.
    ranges = min(MOST_RANGES, 4 * pages.count() // sweep_rows + 1)
    both = urls.unionByName(starts).repartitionByRange(ranges, "key", "path", "kind", "row")
    return saved(both.withColumn("range", F.spark_partition_id()), "ranges")


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", sweep_rows: int = SWEEP_ROWS
) -> DataFrame:
    """page_id, host, path, the longest rule that fits (or null) and the verdict of every page.

    A rule fits its host and all subdomains where the path starts with the rule's. Of rules of equal length
    the one with the longer host wins; equal rules with both verdicts block. A page with no rule, so also one with a null
    or odd url, gets ``default``; without rules every page does. Repeated rows stay. Only page_id and url are read; columns
    named host, path or verdict do not disturb.
    """
    placed = _ranged(pages, rules, sweep_rows)
    rule = F.when(F.col("kind") == 0, F.struct("level", "stack"))
    ends = placed.where("kind = 0").groupBy("range").agg(F.max_by(F.struct("level", "stack"), F.struct("key", "path")).alias("end"))
    # One row a range, so all fit one array: each range gets the end of the last one before it that has a rule.
    listed = ends.agg(F.array_sort(F.collect_list(F.struct("range", "end"))).alias("ends"))
    known = F.transform("ends", lambda e, i: F.struct(e["range"].alias("from"), F.get(F.col("ends"), i + 1)["range"].alias("to"), e["end"].alias("carried")))
    spans = listed.select(F.explode(known).alias("k")).select("k.*")
    last = F.coalesce(F.col("to"), F.lit(MOST_RANGES * 2))
    carried = spans.select(F.explode(F.sequence(F.col("from") + 1, last)).alias("range"), "carried")
    sweep = Window.partitionBy("range").orderBy("key", "path", "kind", "row").rowsBetween(Window.unboundedPreceding, 0)
    within = placed.withColumn("within", F.last(rule, ignorenulls=True).over(sweep)).where("kind = 1")
    swept = within.join(carried, "range", "left").withColumn("passed", F.coalesce("within", "carried"))
    active = F.filter(F.col("passed.stack"), lambda r: F.col("path").startswith(r["path"]))
    top = F.when(F.col("passed.level").eqNullSafe(F.col("level")), F.get(active, F.lit(0)))
    best = swept.withColumn("hit", top).withColumn(
        "found",
        F.when(
            F.col("hit").isNotNull(),
            F.struct(
                (F.length("level") + F.col("hit.n")).alias("n"), F.length("level").alias("m"),
                F.concat("level", "hit.path").alias("rule"), F.col("hit.verdict").alias("verdict"),
            ),
        ),
    )
    return (
        best.groupBy("row")
        .agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("found").alias("found"))
        .select(
            "page_id", "host", "path", F.col("found.rule").alias("rule"),
            F.coalesce("found.verdict", F.lit(default)).alias("verdict"),
        )
    )
