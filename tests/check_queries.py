"""Run registered queries beside their SQL: python tests/check_queries.py SF_DIR [name ...]"""

import sys
import time

import duckdb
import pandas as pd

TABLES = ("documents", "conversations", "benchmark", "pages", "labels")


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(frame: pd.DataFrame):
    """Sorted rows with columns by name; numbers compare by value, not by width."""
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, (tuple(map(plain, row)) for row in frame.itertuples(index=False))))


def plain(value):
    if value is None or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    return value


def compare(spark, con, sf_dir, query, check):
    """None if the query gives what its SQL gives, else a description of the difference."""
    got = query(spark, sf_dir).toPandas()
    want = con.sql(check).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    left, right = rows_of(got), rows_of(want)
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"{a[:300]} against {b[:300]}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, checks = connect(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in checks:
                result = compare(spark, con, sf_dir, query, checks[name]) or "ok"
            else:
                result = f"{query(spark, sf_dir).count()} rows, no SQL"
        except Exception as error:
            result = f"{type(error).__name__}: {str(error)[:400]}"
        print(f"{name:28} {time.time() - start:6.1f}s  {result}", flush=True)
