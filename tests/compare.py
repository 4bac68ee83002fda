"""Rows of a query against the rows of its SQL."""

import os


def sql_rows(sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con.execute(sql).df()


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


def plain(value):
    return value.item() if hasattr(value, "item") else value


def same(frame, other):
    assert sorted(frame.columns) == sorted(other.columns)
    a, b = ([tuple(map(plain, r)) for r in f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).itertuples(index=False, name=None)] for f in (frame, other))
    assert sorted(a, key=repr) == sorted(b, key=repr)
