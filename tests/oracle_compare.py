"""Compare a Spark result with DuckDB's answer to the check SQL (order-insensitive)."""

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return None if value is None else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in data]
    return sorted(columns), sorted(out, key=lambda r: tuple("" if c is None else c for c in r))


def compare(df, con, sql):
    relation = con.sql(sql)
    want = rows(list(relation.columns), relation.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    wrong = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert not wrong, wrong[:3]
    return len(got[1])
