"""Run registered queries beside their SQL on the same parquet tables."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(repr(tuple(row[i] for i in order)) for row in values)


def compare(name, spark, con, sf_dir, queries, oracles):
    started = time.time()
    df = queries[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    spark_time = time.time() - started
    if name not in oracles:
        return None, len(got[1]), spark_time, ""
    cursor = con.execute(oracles[name])
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    if got == want:
        return True, len(got[1]), spark_time, ""
    note = f"columns {got[0]} / {want[0]}; rows {len(got[1])} / {len(want[1])}"
    extra = sorted(set(got[1]) - set(want[1]))[:3], sorted(set(want[1]) - set(got[1]))[:3]
    return False, len(got[1]), spark_time, f"{note}\n   spark only {str(extra[0])[:1500]}\n   sql only {str(extra[1])[:1500]}"


def main():
    from __spark_entry__ import oracle_sql, queries
    from molcorpus.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    known, oracles = queries(), oracle_sql()
    names = sys.argv[2:] or list(known)
    spark, con = local_session("8"), connect(sf_dir)
    failed = []
    for name in names:
        try:
            ok, n, seconds, note = compare(name, spark, con, sf_dir, known, oracles)
        except Exception as error:  # report and go on with the others
            ok, n, seconds, note = False, 0, 0.0, str(error)[:1500]
        print(f"{name:28} {'rows only' if ok is None else 'ok' if ok else 'DIFFERENT'} {n} rows {seconds:.1f}s {note}", flush=True)
        if ok is False:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
