"""Run registered queries and their SQL twins side by side.

``python tests/compare.py [sf_dir] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def database(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(plain(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in row),
    )


def differences(spark_df, con, statement, limit: int = 3) -> list[str]:
    """Empty when both sides agree in columns and rows."""
    got = rows_of(spark_df.columns, spark_df.collect())
    answer = con.sql(statement)
    want = rows_of(answer.columns, answer.fetchall())
    if sorted(spark_df.columns) != sorted(answer.columns):
        return [f"columns {sorted(set(spark_df.columns) ^ set(answer.columns))}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"]
    names = sorted(answer.columns)
    found = []
    for a, b in zip(got, want):
        if a != b:
            found.append(str([(n, x, y) for n, x, y in zip(names, a, b) if x != y]))
            if len(found) >= limit:
                break
    return found


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(contract.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, statements = database(sf_dir), contract.oracle_sql()
    for name in chosen:
        started = time.time()
        try:
            df = contract.queries()[name](spark, sf_dir)
            if name in statements:
                found = differences(df, con, statements[name])
                verdict = f"same {con.sql(statements[name]).aggregate('count(*)').fetchall()[0][0]}" if not found else "DIFFERENT " + " | ".join(found)[:600]
            else:
                verdict = f"rows {len(df.collect())}, no SQL twin"
        except Exception as problem:  # report every query, then go on
            verdict = f"FAILED {type(problem).__name__}: {str(problem)[:600]}"
        print(f"{name:32s} {time.time() - started:6.1f}s {verdict}", flush=True)


if __name__ == "__main__":
    main()
