"""Run registered queries in Spark and in DuckDB and compare every value.

python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import decimal
import math
import pathlib
import sys
import time

import duckdb

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return str(int(value)) if value == int(value) else repr(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cursor = con.execute(sql)
    return rows_of([d[0] for d in cursor.description], cursor.fetchall())


def difference(got, want, show=3):
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return None
    left, right = set(got[1]), set(want[1])
    return (
        f"rows {len(got[1])} vs {len(want[1])}\n  spark only: {sorted(left - right)[:show]}"
        f"\n  duckdb only: {sorted(right - left)[:show]}"
    )[:3000]


def main() -> int:
    from talkweave.session import local_session

    import __spark_entry__ as contract

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    queries, oracle = contract.queries(), contract.oracle_sql()
    if names:
        queries = {k: v for k, v in queries.items() if any(k == n or k.startswith(n.rstrip("*")) and n.endswith("*") for n in names)}
    spark, con, failed = local_session(8), duck(folder), []
    for name, run in queries.items():
        begin = time.time()
        try:
            got = spark_rows(run(spark, folder))
            mid = time.time()
            if name not in oracle:
                result = None if got[1] else "no rows"
                note = "rows only"
            else:
                result = difference(got, duck_rows(con, oracle[name]))
                note = ""
            if not got[1]:
                note += " EMPTY"
            print(f"{'ok  ' if result is None else 'FAIL'} {name} rows={len(got[1])} "
                  f"spark={mid - begin:.2f}s duck={time.time() - mid:.2f}s {note} {result or ''}", flush=True)
        except Exception as error:  # report and go on with the next query
            result = str(error)[:1500]
            print(f"ERR  {name} {result}", flush=True)
        if result is not None:
            failed.append(name)
    print(f"{len(queries) - len(failed)}/{len(queries)} equal; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
