"""Runs queries on Spark and their SQL on DuckDB, and compares the rows.

    python -m tests.oracle [sf_dir] [query ...]
"""

import datetime as dt
import decimal
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session(cores: int = 8) -> SparkSession:
    from fillwise.session import configure

    spark = (
        configure(SparkSession.builder.master(f"local[{cores}]").appName("checks"))
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "10g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return None if math.isnan(number) else repr(number + 0.0)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return str(value)


def _table(names, rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, con, sf_dir: str, query, sql: str | None) -> tuple[str, int, float]:
    start = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return "rows only", len(rows), took
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(names)}", len(rows), took
    mine, theirs = _table(df.columns, rows), _table(names, expected)
    if mine == theirs:
        return "ok", len(rows), took
    extra = [r for r in mine if r not in set(theirs)][:3]
    missing = [r for r in theirs if r not in set(mine)][:3]
    return f"ROWS {len(mine)} vs {len(theirs)} {sorted(names)}\n   spark  {extra}\n   oracle {missing}", len(rows), took


def main() -> None:
    sys.path.insert(0, ".")
    import __spark_entry__ as e

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con, sql = session(), database(sf_dir), e.oracle_sql()
    bad = 0
    for name, query in e.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            verdict, n, took = compare(spark, con, sf_dir, query, sql.get(name))
        except Exception as error:  # report and go on with the next query
            verdict, n, took = f"ERROR {str(error)[:900]}", 0, 0.0
        bad += verdict not in ("ok", "rows only")
        print(f"{name:32s} {n:9d} rows {took:6.2f}s  {verdict}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
