"""Compare registered queries with their SQL twins.

    python tests/oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _rows(arrow):
    columns = sorted(arrow.column_names)
    data = [arrow.column(c).to_pylist() for c in columns]
    types = [str(arrow.schema.field(c).type) for c in columns]
    return columns, types, sorted(zip(*data), key=repr) if columns else []


def _near(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def compare(spark, con, name, query, sql, sf_dir):
    """(status, detail); status is exact, near, rows-only or FAIL."""
    started = time.time()
    got_columns, got_types, got = _rows(query(spark, sf_dir).toArrow())
    took = time.time() - started
    if sql is None:
        return "rows-only", f"{len(got)} rows {took:.1f}s {got_columns}"
    want_columns, want_types, want = _rows(con.sql(sql).to_arrow_table())
    detail = f"{len(got)} rows {took:.1f}s"
    if got_columns != want_columns:
        return "FAIL", f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return "FAIL", f"{len(got)} rows, oracle {len(want)}"
    if got == want or [tuple(map(repr, r)) for r in got] == [tuple(map(repr, r)) for r in want]:
        status = "exact"
    elif all(_near(a, b) for g, w in zip(got, want) for a, b in zip(g, w)):
        status = "near"
    else:
        bad = [(g, w) for g, w in zip(got, want) if not all(map(_near, g, w))][:2]
        return "FAIL", f"{got_columns} {bad}"
    kinds = [f"{c}:{g}/{w}" for c, g, w in zip(got_columns, got_types, want_types) if g != w]
    return status, detail + (f" types {kinds}" if kinds else "") + ("" if got else " EMPTY")


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from steplake.session import get_session

    spark = get_session("oracle", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                        spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if args.names and not any(n in name for n in args.names):
            continue
        try:
            status, detail = compare(spark, con, name, query, sqls.get(name), args.sf)
        except Exception as error:  # report every query, whatever happens to one of them
            status, detail = "FAIL", f"{type(error).__name__}: {str(error)[:600]}"
            if args.names:
                traceback.print_exc()
        failed += status == "FAIL"
        print(f"{status:10} {name}: {detail}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
