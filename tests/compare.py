"""Run registered queries against DuckDB on the driver tables."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations "
    "clicks sales sale_lines clients client_changes vendors items stamps"
).split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, list):
        return tuple(map(plain, v))
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    expected = rows_of([d[0] for d in rel.description], rel.fetchall())
    assert got[0] == expected[0], (name, got[0], expected[0])
    assert len(got[1]) == len(expected[1]), (name, len(got[1]), len(expected[1]))
    for a, b in zip(got[1], expected[1]):
        assert a == b, (name, a, b)
    return len(got[1])
