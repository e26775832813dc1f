"""Spark rows against DuckDB rows, as texts."""

import os

import duckdb


def text(v) -> str:
    if v is None:
        return "-"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "-" if v != v else repr(round(v, 6))
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return "[" + ",".join(map(text, v)) + "]"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{text(x)}" for k, x in v.items()) + "}"
    if type(v).__name__ == "Decimal":
        return repr(round(float(v), 6))
    return str(v)


def connect(folder: str):
    con = duckdb.connect()
    for t in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{folder}/{t}'")
    return con


def same(df, con, sql: str) -> None:
    cols = sorted(df.columns)
    got = sorted("|".join(text(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted("|".join(text(r[i]) for i in at) for r in cur.fetchall())
    assert got == want
