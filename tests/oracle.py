"""Compare registered Spark queries with their DuckDB oracle SQL.

    python -m tests.oracle [--sf /root/testdata/sf0.01] [name ...]

Row count, column names and an order-insensitive comparison of normalised
values, as the driver's correctness gate does.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float | np.floating):
        if math.isnan(v):
            return None
        return round(float(v), 6)
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, int | np.integer):
        return int(v)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, pd.Timestamp):
        if v is pd.NaT:
            return None
        return v.tz_localize(None).isoformat() if v.tzinfo else v.isoformat()
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if v is pd.NaT:
        return None
    if isinstance(v, np.ndarray | list | tuple):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(out, key=repr)


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> tuple[bool, str]:
    a, b = sorted(spark_pdf.columns), sorted(duck_pdf.columns)
    if a != b:
        return False, f"columns differ: spark={a} oracle={b}"
    if len(spark_pdf) != len(duck_pdf):
        return False, f"rows differ: spark={len(spark_pdf)} oracle={len(duck_pdf)}"
    ra, rb = rows(spark_pdf), rows(duck_pdf)
    if ra != rb:
        diff = [(x, y) for x, y in zip(ra, rb) if x != y][:3]
        return False, f"values differ, first: {diff}"
    return True, f"{len(ra)} rows"


def check(spark, names: list[str] | None, sf_dir: str, verbose: bool = True) -> dict[str, tuple[bool, str]]:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            spdf = qs[name](spark, sf_dir).toPandas()
            t1 = time.time()
            if name in sqls:
                dpdf = con.sql(sqls[name]).df()
                ok, msg = compare(spdf, dpdf)
            else:
                ok, msg = True, f"{len(spdf)} rows (no oracle)"
        except Exception as e:  # report and continue
            ok, msg, t1 = False, f"error: {type(e).__name__}: {str(e)[:400]}", time.time()
        results[name] = (ok, msg)
        if verbose:
            print(f"{'OK ' if ok else 'BAD'} {name:28s} {t1 - t0:6.2f}s  {msg}", flush=True)
    return results


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from runlake.session import local_session
    spark = local_session()
    res = check(spark, args.names or None, args.sf)
    bad = [k for k, (ok, _) in res.items() if not ok]
    print(f"{len(res) - len(bad)}/{len(res)} match; bad: {bad}")


if __name__ == "__main__":
    main()
