"""Compares a query with its SQL on the same tables."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return repr(v)
    return f"{float(v):.9g}" if isinstance(v, float) or hasattr(v, "as_tuple") else repr(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


def differences(spark, con, sf_dir, f, sql):
    """Both results as sorted rows with columns by name; what differs, if anything."""
    df = f(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} and {names}"
    if got != want:
        a, b = set(got), set(want)
        return f"{len(got)} and {len(want)} rows; only here {sorted(a - b)[:3]}, only there {sorted(b - a)[:3]}"
    return "" if want or os.environ.get("EMPTY_OK") else "no rows"
