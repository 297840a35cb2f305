"""Run registered queries and their DuckDB twins side by side (as the driver does).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query and a JSON summary; exit code 1 on any mismatch.
"""

from __future__ import annotations

import json
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

# STRICT=1 compares floats bit for bit (no rounding on the Python side).
STRICT = os.environ.get("STRICT") == "1"

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(x):
    if isinstance(x, float):
        if math.isnan(x):
            return "nan"
        return x if STRICT else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(_norm(y) for y in x)
    if hasattr(x, "item"):
        return _norm(x.item())
    return x


SPARK_TO_DUCK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "smallint": "SMALLINT",
    "tinyint": "TINYINT",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def type_mismatches(df, rel) -> list:
    spark_t = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    duck_t = {d[0]: str(d[1]) for d in rel.description}
    return [(c, spark_t[c], duck_t.get(c)) for c in spark_t if duck_t.get(c) != spark_t[c]]


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, name: str, fn, sql: str | None, con) -> dict:
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    cols = df.columns
    t1 = time.time()
    out = {"name": name, "rows": len(rows), "spark_s": round(t1 - t0, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    rel = con.execute(sql)
    ocols = [d[0] for d in rel.description]
    orows = rel.fetchall()
    out["oracle_rows"] = len(orows)
    if sorted(cols) != sorted(ocols):
        out["status"] = f"COLUMNS {sorted(cols)} vs {sorted(ocols)}"
        return out
    bad_types = type_mismatches(df, rel)
    if bad_types:
        out["status"] = f"TYPES {bad_types}"
        return out
    a, b = canon(rows, cols), canon(orows, ocols)
    if len(a) != len(b):
        out["status"] = "ROWCOUNT"
        return out
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    out["status"] = "ok" if not bad else f"VALUES {len(bad)} differ, e.g. {bad[:2]}"
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from quiver.session import get_session

    spark = get_session()
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = []
    for name in names or sorted(qs):
        try:
            r = compare(spark, sf_dir, name, qs[name], sqls.get(name), con)
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        print(json.dumps(r), flush=True)
        results.append(r)
    bad = [r["name"] for r in results if r["status"] not in ("ok", "rows-only")]
    print(json.dumps({"total": len(results), "bad": bad}))
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
