"""Holds registered queries against their SQL in DuckDB: python tests/compare.py SF_DIR [NAME...]."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """A value that both engines write alike."""
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return int(v) if isinstance(v, int) and not isinstance(v, bool) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def oracle(sf_dir, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def differences(df, sf_dir, sql):
    """What differs between a DataFrame and its SQL, in words; empty if nothing does."""
    names, want = oracle(sf_dir, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of(names, want)
    if len(got) != len(want):
        return f"{len(got)} rows, not {len(want)}"
    odd = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(odd)} of {len(got)} rows, such as {odd[0][0]} for {odd[0][1]}" if odd else ""


def main(sf_dir, names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sql, bad = entry.oracle_sql(), 0
    for name in names or sql:
        began = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            said = differences(df, sf_dir, sql[name]) if name in sql else f"no SQL; {df.count()} rows"
        except Exception as error:
            said = f"{type(error).__name__}: {str(error)[:400]}"
        bad += bool(said) and name in sql
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
