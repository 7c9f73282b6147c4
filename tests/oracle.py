"""Runs queries and their SQL side by side: python -m tests.oracle SF_DIR [NAME...]"""

import math
import sys
import time


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: "NaN" if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def connect(sf_dir):
    import os

    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{name}{'/*' if os.path.isdir(f'{sf_dir}/{name}') else ''}')")
    return con


def compare(spark, con, sf_dir, name, query, sql):
    df = query(spark, sf_dir)
    got, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want, names = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != names:
        return f"columns {cols} and {names}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return f"{len(got)} and {len(want)} rows; {str(diff)[:600]}"
    return "" if got or "equals" in name or "empty" in name or "miss" in name else "no rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sys.argv[1])
    queries, sqls = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or sorted(sqls):
        t = time.time()
        try:
            said = compare(spark, con, sys.argv[1], name, queries[name], sqls[name]) or "ok"
        except Exception as x:
            said = f"ERROR {str(x)[:500]}"
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)
