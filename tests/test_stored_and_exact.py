"""Bitmaps, fingerprints, selection, as-of joins and stored layouts against plain code, and the plans they must have."""

import datetime as dt
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelry.operators import asof, distinct_counts, duplicates, filters, selection
from panelry.sources import io, stored

START = dt.date(2020, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- distinct counts -----------------------------------------------------------------------------


def test_bitmaps_roll_up_to_distinct_counts(spark):
    rng = random.Random(1)
    rows = [(START + dt.timedelta(rng.randrange(90)), rng.randrange(4), rng.choice([rng.randrange(100), 32_767 + rng.randrange(3), 10**9 + rng.randrange(50), None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "date date, store int, item long")
    maps = distinct_counts.item_bitmaps(df, "item", [["date"], ["store"]])
    assert set(maps.columns) == {"date", "store", "level", "bucket", "bits"}
    for level, key in ((0, F.col("date")), (0, F.trunc("date", "month")), (1, F.col("store"))):
        want = {r.k: r.n for r in df.groupBy(key.alias("k")).agg(F.count_distinct("item").alias("n")).collect()}
        got = {r.k: r.active_items for r in distinct_counts.distinct_items(maps, level, key, "k").collect()}
        assert got == {k: n for k, n in want.items() if n}
    assert distinct_counts.item_bitmaps(df.limit(0), "item", [["date"]]).count() == 0


# ---- duplicate rows ------------------------------------------------------------------------------


def repeated(spark):
    rows = [("a", None, 1.0), ("a", None, 1.0), (None, "a", 1.0), ("b", "c", -0.0), ("b", "c", 0.0), ("b", "c", float("nan")), ("b", "c", float("nan"))]
    return spark.createDataFrame(rows + [("x", str(i), float(i)) for i in range(200)] * 2, "p string, q string, v double")


def test_duplicates_equal_a_plain_count(spark):
    df = repeated(spark)
    assert duplicates.duplicate_rows(df).first()[0] == df.count() - df.distinct().count() == 203
    assert duplicates.duplicate_rows(df.limit(0)).first()[0] == 0


@pytest.mark.parametrize("prints", [
    lambda df: (F.lit(1).cast("long"), F.lit(2).cast("long")),
    lambda df: (F.xxhash64("v") % 5, F.lit(0).cast("long")),
])
def test_forced_collisions_are_told_apart(spark, prints):
    assert duplicates.duplicate_rows(repeated(spark), prints).first()[0] == 203


def test_rows_without_copies_are_not_shuffled_whole(spark):
    df = spark.createDataFrame([(f"text {i}", i) for i in range(3000)], "t string, i long")
    ids = df.limit(0).select(F.lit(1).cast("long").alias("h"))
    assert filters.rows_maybe_in(df, F.xxhash64("t"), ids, F.col("h")).count() == 0
    some = df.where("i < 100").select(F.xxhash64("t").alias("h"))
    assert 100 <= filters.rows_maybe_in(df, F.xxhash64("t"), some, F.col("h")).count() < 110
    counts = df.select(*[c.alias(n) for c, n in zip(duplicates.fingerprint(df), "ab")]).groupBy("a", "b").count()
    assert not [line for line in plan(counts).splitlines() if "Exchange" in line and re.search(r"\bt#", line)]


# ---- selection -----------------------------------------------------------------------------------


@pytest.mark.parametrize("buckets,small", [(4, 3), (256, 50_000), (2, 1)])
def test_quantiles_equal_percentile(spark, buckets, small):
    rng = random.Random(2)
    rows = [(g, v) for g, n in (("a", 101), ("b", 40), (None, 7), ("one", 1)) for v in (rng.choice([rng.gauss(0, 1), 1e12 * rng.random(), 0.0, None]) for _ in range(n))]
    rows += [("one", 5.0), ("flat", 3.0), ("flat", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    points = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    want = {(r.g, p): x for r in df.groupBy("g").agg(F.percentile("v", points).alias("x")).collect() if r.x for p, x in zip(points, r.x)}
    got = {(r.g, r.probability): r.value for r in selection.exact_quantiles(df, "v", points, ["g"], buckets, small).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_quantiles_of_ten_million_distinct_values(spark):
    n = 10_000_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("v"))
    got = sorted((r.probability, r.value) for r in selection.exact_quantiles(df, "v", [0.25, 0.5, 0.999]).collect())
    assert got == [(p, pytest.approx(p * (n - 1))) for p in (0.25, 0.5, 0.999)]


# ---- as-of join ----------------------------------------------------------------------------------


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("width", [1, 16, 10_000])
def test_asof_equals_a_lookup(spark, width, inclusive):
    rng = random.Random(width)
    entries = [(rng.choice("abc"), rng.choice([rng.randrange(400), None]), rng.choice([rng.random(), None])) for _ in range(60)] + [(None, 5, 9.0)]
    rows = [(rng.choice(["a", "a", "b", "c", "d", None]), rng.choice([rng.randrange(450), None]), i // 2) for i in range(300)]
    e = spark.createDataFrame(entries, "k string, t long, price double")
    r = spark.createDataFrame(rows + rows[:5], "k string, t long, id long")

    def lookup(k, t):
        seen = [(x, (p is not None, p)) for a, x, p in entries if a == k and k is not None and t is not None and x is not None and (x < t or inclusive and x == t)]
        return max(seen)[1][1] if seen else None

    got = asof.asof_join(r, e, ["k"], "t", ["price"], width, inclusive)
    assert got.columns == ["k", "t", "id", "price"]
    key = lambda row: tuple(map(str, row))
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(k, t, i, lookup(k, t)) for k, t, i in rows + rows[:5]], key=key)


def test_asof_of_empty_tables(spark):
    e, r = spark.createDataFrame([], "k string, t long, price double"), spark.createDataFrame([("a", 1)], "k string, t long")
    assert [tuple(x) for x in asof.asof_join(r, e, ["k"], "t", ["price"]).collect()] == [("a", 1, None)]
    assert asof.asof_join(r.limit(0), e, ["k"], "t", ["price"]).count() == 0


# ---- stored layouts ------------------------------------------------------------------------------


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_joins_of_bucketed_tables_have_no_exchange(spark, no_broadcast):
    facts = stored.bucketed(spark.range(500).selectExpr("id % 40 item", "id % 7 week", "id units"), "facts", ["item", "week"], 4)
    prices = stored.bucketed(spark.range(280).selectExpr("id % 40 item", "id div 40 week", "id * 1.5 price"), "prices", ["item", "week"], 4)
    joined = facts.join(prices, ["item", "week"])
    assert joined.count() == 500 and "Exchange" not in plan(joined)
    items = stored.bucketed(spark.range(500).selectExpr("id % 40 item", "id units"), "days", ["item"], 4)
    best = stored.bucketed(spark.range(5).selectExpr("id item"), "best", ["item"], 4)
    chosen = items.join(best, "item", "left_semi")
    assert chosen.count() == 65 and "Exchange" not in plan(chosen)


def by_day(spark, n=400):
    return spark.createDataFrame([(START + dt.timedelta(i), i) for i in range(n)], "date date, v long")


def test_only_asked_months_are_read(spark):
    table = stored.by_month(by_day(spark))
    days = io.materialize(by_day(spark).select("date"), "days").where(F.col("date").between("2020-03-10", "2020-04-02"))
    got = stored.between_days(table, days)
    assert got.count() == 24 and "dynamicpruning" in plan(got).lower()
    assert got.agg(F.min("v"), F.max("v")).first() == (69, 92)
    whole = {f.split("/year_month=")[1][:10] for f in table.inputFiles()}
    assert len(whole) == 14 and {str(r[0]) for r in got.select("year_month").distinct().collect()} == {"2020-03-01", "2020-04-01"}


def contents(path):
    return {f.relative_to(path).as_posix(): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_a_rollup_rewrites_only_the_months_of_new_lines(spark, tmp_path):
    path = str(tmp_path / "rollup")
    lines = by_day(spark, 200).withColumn("k", F.col("v") % 3)
    rollup = stored.RollUp(path, ["k"], {"v": F.sum("v"), "n": F.count(F.lit(1))})
    first = lines.where("date < '2020-05-01' and v <> 40")
    rollup.create(first)
    before = contents(path)
    late = lines.where("date >= '2020-05-01' or v = 40")  # day 40 is in February
    rollup.add(late)
    after = contents(path)
    months = lambda files: {f.split("/")[0][-10:] for f in files}
    untouched = {f for f in before if after.get(f) == before[f]}
    assert months(untouched) == {"2020-01-01", "2020-03-01", "2020-04-01"}
    whole = lines.groupBy(F.trunc("date", "month").alias("year_month"), "k").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
    columns = ["year_month", "k", "v", "n"]
    assert sorted(map(tuple, rollup.read(spark).select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))
    rollup.add(lines.limit(0))
    assert contents(path) == after
