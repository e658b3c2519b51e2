"""Run named queries in Spark and their SQL in DuckDB and compare rows regardless of order."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from contrail.plans.airline_views import BASE_TABLES  # noqa: E402
from contrail.session import local_session  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame(index=df.index)
    for c in sorted(df.columns):
        s = df[c]
        if pd.api.types.is_float_dtype(s):
            out[c] = s.map(lambda v: "null" if pd.isna(v) else f"{v + 0.0:.6f}")
        elif pd.api.types.is_bool_dtype(s):
            out[c] = s.astype(str)
        else:
            out[c] = s.map(lambda v: "null" if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)) else str(v))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def difference(name: str, spark, con, folder: str, empty: bool = False) -> str | None:
    """None when both agree, otherwise what differs; no rows on either side only agree when `empty` is allowed."""
    ours = entry.queries()[name](spark, folder).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if len(ours) else "no rows"
    theirs = con.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} vs {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    if len(ours) == 0:
        return None if empty else "no rows"
    for c in ours.columns:  # whole numbers with nulls
        if str(ours[c].dtype) == "float64" and str(theirs[c].dtype) == "Int64":
            theirs[c] = theirs[c].astype("float64")
    kinds = {c: (str(ours[c].dtype), str(theirs[c].dtype)) for c in ours.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1]}
    a, b = canonical(ours), canonical(theirs)
    if not a.equals(b):
        bad = (a != b).any(axis=1)
        return f"{int(bad.sum())} rows differ: {a[bad].head(3).to_dict('records')} vs {b[bad].head(3).to_dict('records')}"
    return f"types {odd}" if odd else None


if __name__ == "__main__":
    folder = "/root/testdata/sf0.01"
    wanted = sys.argv[1:]
    names = [n for n in entry.queries() if not wanted or any(w in n for w in wanted)]
    spark = local_session(cores="8")
    con = connect(folder)
    failures = 0
    for name in names:
        begin = time.time()
        try:
            problem = difference(name, spark, con, folder)
        except Exception as error:  # noqa: BLE001
            problem = f"error {type(error).__name__}: {str(error)[:900]}"
        failures += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - begin:.1f}s {problem or ''}", flush=True)
    print(f"{len(names)} queries, {failures} failures")
