"""Run queries and their SQL side by side and compare all values."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    out = {}
    for c in df.columns:
        col = df[c]
        if pd.api.types.is_datetime64_any_dtype(col):
            col = col.astype("datetime64[us]").astype(str)
        out[c] = [None if pd.isna(x) else x for x in col.astype(object)]
    rows = pd.DataFrame(out, columns=df.columns, dtype=object)
    return rows.sort_values(by=list(rows.columns), key=lambda s: s.map(repr)).reset_index(drop=True)


def kind(dtype) -> str:
    return {"i": "int", "u": "int", "f": "float", "b": "bool", "M": "time"}.get(dtype.kind, "other")


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None if equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for c in got.columns:
        if got[c].notna().all() and want[c].notna().all() and len(got) and kind(got[c].dtype) != kind(want[c].dtype):
            return f"type of {c}: {got[c].dtype} != {want[c].dtype}"
    a, b = plain(got), plain(want)
    for i in range(len(a)):
        if list(a.iloc[i]) != list(b.iloc[i]):
            return f"row {i}:\n  got  {list(a.iloc[i])!r:.1500}\n  want {list(b.iloc[i])!r:.1500}"
    return None


def local_session(cores: int = 8):
    from pyspark.sql import SparkSession

    from scribeloom.scale import session_conf

    builder = SparkSession.builder.master(f"local[{cores}]").appName("check")
    for k, v in session_conf(cores).items():
        builder = builder.config(k, v)
    spark = (
        builder.config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session()
    con = duck(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            got = fn(spark, folder).toPandas()
        except Exception as e:
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:1500]}", flush=True)
            bad += 1
            continue
        mid = time.time()
        if name not in sqls:
            print(f"rows {name}: {len(got)} ({mid - start:.1f}s)", flush=True)
            continue
        try:
            want = con.execute(sqls[name]).df()
        except Exception as e:
            print(f"FAIL {name}: SQL {str(e)[:1500]}", flush=True)
            bad += 1
            continue
        diff = compare(got, want)
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'DIFF'} {name}: {len(got)} rows, spark {mid - start:.1f}s, duckdb {time.time() - mid:.1f}s {diff or ''}", flush=True)
    print("bad:", bad)
