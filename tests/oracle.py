"""Run registered queries next to their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb


# queries without SQL, and the test that holds their operator against another computation
CHECKED_ELSEWHERE = {
    "pca_curves": "test_operators.py, and SQL in pca_two_columns",
    "pca_curves_95": "test_operators.py",
    "gmm_select_by_bic": "test_operators.py: test_mixture_has_the_likelihood_it_reports, and SQL in gmm_two_columns",
    "assign_modes": "test_operators.py: test_mixture_has_the_likelihood_it_reports, and SQL in assign_fixed_modes",
    "mode_gof": "test_operators.py, and SQL in assign_fixed_modes and chi_square_gof",
    "ridge_cv_r2": "test_operators.py, and SQL in ridge_one_column",
    "permutation_null": "test_operators.py",
    "embedding_regressor": "test_operators.py, and SQL in embedding_regressor_one_column",
    "bootstrap_ci_median_large": "test_operators.py: test_bootstrap_has_the_distribution_of_resampling",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.splitext(os.path.basename(f))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, int):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return str(v)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        if name not in CHECKED_ELSEWHERE:
            return False, "no SQL, and not listed as checked elsewhere"
        return bool(got), f"rows only: {len(got)} rows {took:.1f}s; see {CHECKED_ELSEWHERE[name]}"
    if not got:
        return False, "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return False, f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]
    kinds = {c: {type(r[i]).__name__ for r in rows if r[i] is not None} for rows in (got,) for i, c in enumerate(cols)}
    kinds2 = {c: {type(r[i]).__name__ for r in want if r[i] is not None} for i, c in enumerate(cols)}
    a, b = Counter(got), Counter(want)
    if a == b:
        note = "" if kinds == kinds2 else f" type difference {kinds} {kinds2}"
        return not note, f"{len(got)} rows {took:.1f}s{note}"
    only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
    n = sum((a - b).values())
    return False, f"{len(got)} against {len(want)} rows, {n} differ {took:.1f}s\n   cols   {cols}\n   spark  {only_a}\n   duckdb {only_b}"


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from cloudgauge.plans import QUERIES
    from cloudgauge.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        if name not in QUERIES and name not in oracles:
            print("    ", name, "has tests of its own, and no SQL", flush=True)
            continue
        try:
            ok, note = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
