"""Runs queries against their DuckDB statements: python tests/oracle_check.py DIR [NAME...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(plain(i) for i in x)
    if hasattr(x, "asDict"):
        return tuple(plain(i) for i in x)
    return x


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def oracle_rows(con, sql):
    r = con.execute(sql)
    order = sorted(range(len(r.description)), key=lambda i: r.description[i][0])
    names = [r.description[i][0] for i in order]
    return names, sorted((tuple(plain(x[i]) for i in order) for x in r.fetchall()), key=repr)


#: Spark's type names for DuckDB's.
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def types_of(df, con, sql) -> str:
    here = {c: t for c, t in df.dtypes}
    there = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return ", ".join(f"{c}: {here[c]} and {there[c]}" for c in here if c in there and KINDS.get(there[c], there[c]) != here[c])


def compare(spark, con, sf_dir, f, sql) -> str:
    df = f(spark, sf_dir)
    if kinds := types_of(df, con, sql):
        return f"types {kinds}"
    got, want = rows_of(df), oracle_rows(con, sql)
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] == want[1]:
        return ""
    more, less = [x for x in got[1] if x not in set(want[1])][:3], [x for x in want[1] if x not in set(got[1])][:3]
    return f"{len(got[1])} and {len(want[1])} rows; only here {more}; only there {less}"


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con, queries, sql, wrong = connection(sf_dir), entry.queries(), entry.oracle_sql(), 0
    for name in names or sql:
        began = time.time()
        try:
            said = compare(spark, con, sf_dir, queries[name], sql[name])
        except Exception as error:  # noqa: BLE001
            said = f"{type(error).__name__}: {str(error)[:600]}"
        wrong += bool(said)
        print(f"{'WRONG' if said else 'ok   '} {name} {time.time() - began:.1f} {said[:1500]}", flush=True)
    print(wrong, "wrong")
    return int(bool(wrong))


if __name__ == "__main__":
    sys.exit(main())
