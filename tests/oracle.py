"""Compares a Spark result with an oracle query in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def connect(folder=DATA):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def same(df, con, sql, empty=False):
    """An empty result tests nothing and fails, unless it is what the test is about."""
    mine = normal([tuple(r) for r in df.collect()], df.columns)
    rel = con.sql(sql)
    theirs = normal(rel.fetchall(), rel.columns)
    assert sorted(df.columns) == sorted(rel.columns)
    assert mine == theirs
    assert mine or empty
