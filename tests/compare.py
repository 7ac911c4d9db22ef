"""Runs registered queries against their checking SQL, the way the driver does."""
import math
import sys
import time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _kind(dtype) -> str:
    text = str(dtype)
    for k in ("int", "float", "bool", "datetime"):
        if text.startswith(k):
            return k
    return "object"


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    return str(v)


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted((tuple(_cell(v) for v in r) for r in df.itertuples(index=False, name=None)), key=str)


def compare(spark_df, sql_df: pd.DataFrame) -> str:
    got = spark_df.toPandas()
    if sorted(got.columns) != sorted(sql_df.columns):
        return f"columns {sorted(got.columns)} vs {sorted(sql_df.columns)}"
    if len(got) != len(sql_df):
        return f"rows {len(got)} vs {len(sql_df)}"
    types = dict(spark_df.dtypes)
    for c in got.columns:
        a, b = _kind(got[c].dtype), _kind(sql_df[c].dtype)
        if a != b and len(got) and not (got[c].isna().any() or sql_df[c].isna().any()):
            return f"type of {c}: {types[c]} vs {sql_df[c].dtype}"
    # integers with NULLs arrive as floats in pandas; compare them as numbers
    for c in got.columns:
        if {"float"} & {_kind(got[c].dtype), _kind(sql_df[c].dtype)}:
            got[c], sql_df[c] = got[c].astype("float64"), sql_df[c].astype("float64")
    a, b = rows(got), rows(sql_df)
    for x, y in zip(a, b):
        if x != y:
            return f"values\n   spark {sorted(got.columns)}\n   spark {x}\n   sql   {y}"
    return f"ok {len(a)}"


def main(sf: str, names: list[str]):
    from lotwise.plans.catalog import ORACLE, QUERIES
    from lotwise.session import build_session
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con, bad = oracle(sf_dir), []
    for name in names or QUERIES:
        t = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLE:
                t2 = time.time()
                want = con.execute(ORACLE[name]).df()
                sql_time = time.time() - t2
                out = compare(df, want)
            else:
                sql_time, out = 0, f"ok (rows only) {df.count()}"
        except Exception as e:  # noqa: BLE001 - a report of every query is wanted
            out, sql_time = "ERROR " + str(e)[:900], 0
        print(f"{name:24s} {time.time() - t - sql_time:6.1f}s sql {sql_time:5.1f}s  {out}", flush=True)
        if not out.startswith("ok"):
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    main(sys.argv[1], sys.argv[2:])
