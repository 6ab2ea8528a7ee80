"""Compare registered queries with their SQL counterparts in DuckDB."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    return value


def sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda row: tuple((v is None, str(type(v)), str(v)) for v in row))


def oracle_rows(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return columns, result.fetchall()


def difference(spark_df, con, sql) -> str | None:
    """None when both sides agree in names, row count and values."""
    columns, expected = oracle_rows(con, sql)
    got = [tuple(r) for r in spark_df.collect()]
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(columns)}"
    a = sorted_rows(got, spark_df.columns)
    b = sorted_rows(expected, columns)
    if len(a) != len(b):
        only_a, only_b = set(map(str, a)) - set(map(str, b)), set(map(str, b)) - set(map(str, a))
        return f"rows {len(a)} != {len(b)}; spark only {list(only_a)[:3]}; sql only {list(only_b)[:3]}"
    bad = [(x, y) for x, y in zip(a, b) if str(x) != str(y)]
    return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[:2]}" if bad else None


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = query(spark, sf)
            n = len(df.collect())
            took = time.time() - start
            problem = difference(df, con, oracles[name]) if name in oracles else None
        except Exception as error:  # report and go on with the next query
            problem, n, took = f"{type(error).__name__}: {str(error)[:1500]}", -1, 0
        failed += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok':4} {kind:4} {name:36} rows={n} {took:6.1f}s of {time.time() - start:6.1f}s {problem or ''}", flush=True)
    print("failed:", failed)
