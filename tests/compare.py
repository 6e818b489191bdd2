"""Spark and DuckDB results brought to one form."""

import math


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float) or type(v).__module__ == "numpy":
        return repr(round(float(v), 9)) if not str(v) in ("True", "False") else str(v)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def of_spark(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def of_duck(con, sql):
    r = con.sql(sql)
    return rows(r.columns, r.fetchall())
