"""Run registered Spark queries next to their DuckDB twins and compare
row count, column names and order-insensitive values (floats to 1e-6)."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

from fleetscope.sources.bindings import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NaT:
        return "<null>"
    if not isinstance(v, (list, tuple, str)) and not hasattr(v, "tolist"):
        try:
            if pd.isna(v):
                return "<null>"
        except (TypeError, ValueError):
            pass
    if isinstance(v, float):
        if math.isnan(v):
            return "<null>"
        return f"{round(v, 6):.6f}"
    if isinstance(v, (pd.Timestamp,)) or hasattr(v, "isoformat"):
        return pd.Timestamp(v).strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(v, bool):
        return str(int(v))
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return "[" + ",".join(_norm(x) for x in list(v)) + "]"
    return str(v)


def rows_of(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return sorted(out)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> dict:
    t0 = time.time()
    frame = fn(spark, sf_dir)
    sdf, sdf_schema = frame.toPandas(), frame.schema
    t1 = time.time()
    res = {"name": name, "spark_rows": len(sdf), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    ddf = con.execute(sql).df()
    # pandas turns whole numbers with nulls into floats, on one side or the other
    for c in (f.name for f in sdf_schema if f.dataType.typeName() in ("byte", "short", "integer", "long")):
        sdf[c] = sdf[c].astype("Int64")
        if c in ddf.columns:
            ddf[c] = ddf[c].astype("Int64")
    res["duck_rows"] = len(ddf)
    if sorted(sdf.columns) != sorted(ddf.columns):
        res["status"] = f"COLUMNS {sorted(sdf.columns)} vs {sorted(ddf.columns)}"
        return res
    a, b = rows_of(sdf), rows_of(ddf)
    if a == b:
        res["status"] = "MATCH"
    else:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["status"] = f"DIFF rows {len(a)} vs {len(b)}; first {diff}"
    return res


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    from fleetscope.session import build_session
    import __spark_entry__ as E
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = argv[2:] if len(argv) > 2 else None
    spark = build_session("local[8]", 8, extra={"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sq = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            r = compare(spark, con, name, fn, sq.get(name), sf_dir)
        except Exception as e:  # report and continue
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("MATCH", "rows-only"):
            bad += 1
        print(r, flush=True)
    print("bad", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
