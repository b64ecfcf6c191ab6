"""Compare registered Spark queries with their DuckDB oracles.

Usage: ``python -m strata.plans.check [sf_dir] [name ...]``. Prints one line
per query: row counts, column match, value match, type differences.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

_SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "float": "FLOAT", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item") and not isinstance(v, (list, tuple, str, bytes)):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def duck_connect(sf_dir: str):
    import duckdb

    from ..sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name: str, sf_dir: str) -> dict:
    from .catalog import ORACLES, QUERIES
    t0 = time.time()
    sdf = QUERIES[name](spark, sf_dir)
    s_cols = sdf.columns
    s_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    s_rec = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(s_rec), "spark_sec": round(t1 - t0, 2)}
    sql = ORACLES.get(name)
    if sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    d_rec = rel.fetchall()
    res["duck_rows"] = len(d_rec)
    res["duck_sec"] = round(time.time() - t1, 2)
    res["cols_ok"] = sorted(s_cols) == sorted(d_cols)
    if not res["cols_ok"]:
        res["cols"] = (sorted(s_cols), sorted(d_cols))
    type_diff = {c: (s_types[c], d_types.get(c)) for c in s_cols
                 if c in d_types and _SPARK_TO_DUCK.get(s_types[c], s_types[c]) != d_types[c]}
    if type_diff:
        res["type_diff"] = type_diff
    a, b = _rows(s_cols, s_rec), _rows(d_cols, d_rec)
    res["values_ok"] = a == b
    if not res["values_ok"] and res["cols_ok"]:
        sa, sb = set(a), set(b)
        res["only_spark"] = list(sa - sb)[:3]
        res["only_duck"] = list(sb - sa)[:3]
    res["status"] = "ok" if res["cols_ok"] and res["values_ok"] and len(s_rec) == len(d_rec) else "MISMATCH"
    return res


def main(argv):
    from ..session import local_session
    from .catalog import QUERIES, load_all
    load_all()
    sf_dir = "/root/testdata/sf0.01"
    names = []
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
        else:
            names.append(a)
    names = names or sorted(QUERIES)
    spark = local_session()
    con = duck_connect(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and go on
            r = {"name": n, "status": "ERROR", "error": str(e)[:800]}
        bad += r["status"] not in ("ok", "rows-only")
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
