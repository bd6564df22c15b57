"""Run registered queries and their DuckDB oracle side by side (test helper and CLI).

python tests/oracle_compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


# Spark simpleString -> DuckDB type name
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "array<int>": "INTEGER[]", "float": "FLOAT", "date": "DATE"}


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "as_integer_ratio") and not isinstance(v, int):  # Decimal
        return round(float(v), 6)
    return v


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _one(fn, sql, spark, sf_dir, con):
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()), key=repr)
    if sql is None:
        return ("rows-only", len(got))
    rel = con.sql(sql)
    dcols, dtypes = rel.columns, [str(t) for t in rel.types]
    drows = rel.fetchall()
    if sorted(dcols) != cols:
        return ("COLUMNS", cols, sorted(dcols))
    stypes = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
              for f in df.schema.fields}
    bad = {c: (stypes[c], t) for c, t in zip(dcols, dtypes) if stypes[c] != t}
    if bad:
        return ("TYPES", bad)
    idx = [dcols.index(c) for c in cols]
    exp = sorted((tuple(_norm(r[i]) for i in idx) for r in drows), key=repr)
    if got == exp:
        return ("ok", len(got))
    diff = [(a, b) for a, b in zip(got, exp) if a != b][:3]
    return ("MISMATCH", len(got), len(exp), diff)


def compare(spark, sf_dir: str, names=None, verbose=True):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in sorted(names or qs):
        t0 = time.time()
        try:
            results[name] = _one(qs[name], sqls.get(name), spark, sf_dir, con)
        except Exception as e:  # noqa: BLE001
            results[name] = ("ERROR", repr(e)[:400])
        if verbose:
            print(f"{name:28s} {time.time() - t0:6.2f}s {results[name]}", flush=True)
    return results


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from labelscope.session import get_session

    spark = get_session("local[8]", shuffle_partitions=8)
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    res = compare(spark, d, sys.argv[2:] or None)
    bad = {k: v for k, v in res.items() if v[0] not in ("ok", "rows-only")}
    print("FAILED:", sorted(bad))
