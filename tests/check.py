"""Run queries beside their SQL and report differences: python tests/check.py [-s DIR] [names...]"""

import argparse
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{directory}/{name}.parquet')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "~" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA else _text(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def _text(v) -> str:
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return str(bool(v))
    try:
        f = float(v)
        return repr(f)
    except (TypeError, ValueError):
        return str(v)


def compare(left: pd.DataFrame, right: pd.DataFrame) -> str:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(set(left.columns) ^ set(right.columns))}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    kinds = [
        f"{c}: {left[c].dtype} vs {right[c].dtype}"
        for c in left.columns
        if left[c].dtype.kind != right[c].dtype.kind and not (left[c].isna().any() or right[c].isna().any())
    ]
    if kinds:
        return f"types {kinds}"
    a, b = normal(left), normal(right)
    bad = [c for c in a.columns if not a[c].equals(b[c])]
    if bad:
        rows = (a[bad] != b[bad]).any(axis=1)
        return f"values in {bad}, {int(rows.sum())} rows\n{a[rows].head(3)}\n{b[rows].head(3)}"
    return ""


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("-s", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from larder.session import build_session

    spark = build_session(master="local[8]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries), set(oracle) - set(queries)
    con = duck(args.s)
    failures = 0
    chosen = [q for q in queries if not args.names or any(q == n or (n.endswith("*") and q.startswith(n[:-1])) for n in args.names)]
    started = time.time()
    for name in chosen:
        t0 = time.time()
        try:
            got = queries[name](spark, args.s).toPandas()
            t1 = time.time()
            want = con.execute(oracle[name]).df() if name in oracle else None
            t2 = time.time()
            verdict = compare(got, want) if want is not None else ""
            kind = "sql" if want is not None else "rows"
            times = f"{t1 - t0:6.2f}s {t2 - t1:5.2f}s"
            rows = len(got)
        except Exception as error:
            verdict, kind, times, rows = f"{type(error).__name__}: {str(error)[:1500]}", "?", "", -1
        failures += bool(verdict)
        print(f"{'FAIL' if verdict else 'ok  '} {kind:4} {name:28} {rows:6} {times} {verdict}", flush=True)
    print(f"{len(chosen)} queries, {failures} failures, {time.time() - started:.0f}s")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
