from __future__ import annotations


def norm(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    return v


def rows_of(df, columns=None):
    columns = columns or sorted(df.columns)
    return sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    rel = con.sql(sql)
    columns = sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    return columns, sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
