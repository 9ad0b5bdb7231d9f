"""Spark-vs-DuckDB comparison used by the tests (mirrors the driver's check: sorted
column names, row count, order-insensitive values)."""

from __future__ import annotations

import math

from .tables import TABLES


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir.rstrip('/')}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return repr(v)          # exact: the driver hashes values, so no tolerance here
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(cols, records):
    out = []
    for r in records:
        out.append(tuple(_norm(r[c]) for c in cols))
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(spark_df, con, sql: str) -> dict:
    """Return a small report: columns, row counts, first differing rows."""
    s_cols = sorted(spark_df.columns)
    s_rows = rows_of(s_cols, [r.asDict() for r in spark_df.collect()])
    rel = con.execute(sql)
    d_cols_raw = [d[0] for d in rel.description]
    d_recs = [dict(zip(d_cols_raw, r)) for r in rel.fetchall()]
    d_cols = sorted(d_cols_raw)
    rep = {"spark_cols": s_cols, "duck_cols": d_cols, "spark_rows": len(s_rows), "duck_rows": len(d_recs)}
    s_types = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    d_types = {d[0]: str(d[1]) for d in rel.description}
    tmap = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    bad_types = {c: (s_types.get(c), d_types.get(c)) for c in s_cols
                 if tmap.get(s_types.get(c), s_types.get(c)) != d_types.get(c)}
    if bad_types:
        rep["type_mismatch"] = bad_types
    if s_cols != d_cols:
        rep["ok"] = False
        return rep
    d_rows = rows_of(d_cols, d_recs)
    bad = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
    rep["ok"] = len(s_rows) == len(d_rows) and not bad
    rep["diff"] = bad[:3]
    return rep
