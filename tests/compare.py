"""Run a query and its SQL twin on the same tables and compare them as multisets."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iufb":
            df[c] = df[c].astype("float64")
        else:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or v != v else str(v)[:10] if hasattr(v, "year") else v)
    return df.sort_values(list(df.columns), kind="mergesort", na_position="first").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None if both hold the same rows, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = _normal(got), _normal(want)
    if a.equals(b):
        return None
    for c in a.columns:
        bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if bad.any():
            i = bad.idxmax()
            return f"{int(bad.sum())} values of {c} differ, first: {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return "dtypes " + str([(c, a[c].dtype, b[c].dtype) for c in a.columns if a[c].dtype != b[c].dtype])


if __name__ == "__main__":
    from verbatim.plans import catalog
    from verbatim.session import local_session

    sf, only = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), duck(sf)
    for name, fn in catalog.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            got = fn(spark, sf).toPandas()
            spent = time.time() - start
            sql = catalog.oracle_sql().get(name)
            start = time.time()
            verdict = "rows only" if sql is None else difference(got, con.execute(sql).df()) or "ok"
            print(f"{name:32s} {spent:6.1f}s duck {time.time() - start:5.1f}s {len(got):8d} rows  {verdict}", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} FAILED {type(e).__name__}: {str(e)[:400]}", flush=True)
