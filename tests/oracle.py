"""Compares a registered query with its SQL in DuckDB."""

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations "
    "clicks sales sale_lines clients client_changes vendors items stamps"
).split()


def one(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, (list, tuple)):
        return str([one(x) for x in v])
    if isinstance(v, dict):
        return str([one(x) for x in v.values()])
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(cols, found):
    """Sorted columns, and the rows as sorted tuples of texts."""
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(one(r[i]) for i in order) for r in found)


def check(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = query(spark, sf_dir)
    want = con.execute(sql)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([d[0] for d in want.description], want.fetchall())
