"""Compare a query with its SQL twin. Usage: python tests/oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_DIR = "/root/testdata/sf0.01"
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _sorted(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in at) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


def differences(df, con, sql: str) -> list[str]:
    """What differs between a Spark result and the SQL result; empty if nothing does."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for name, t in df.dtypes:
        if TYPES.get(t, t) != types[name]:
            out.append(f"type of {name}: {t} != {types[name]}")
    got = [tuple(r) for r in df.collect()]
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    a, b = _sorted(got, df.columns), _sorted(want, names)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        out.append(f"{len(bad)} rows differ, first: {str(bad[0][0])[:300]} != {str(bad[0][1])[:300]}")
    return out


def main() -> None:
    from labelloom.catalog import ENTRIES
    from labelloom.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else SF_DIR
    spark, con = local_session(), database(folder)
    for name, e in ENTRIES.items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            if e.sql is None:
                rows = e.run(spark, folder).collect()
                note = f"rows only: {len(rows)} {rows[:3] if len(rows) < 12 else ''}"
            else:
                found = differences(e.run(spark, folder), con, e.sql)
                note = "ok" if not found else "DIFF " + "; ".join(found)
        except Exception as error:  # report and go on with the next query
            text = str(error).split("JVM stacktrace")[0]
            note = f"ERROR {type(error).__name__} {text[:600]} @ {traceback.extract_tb(error.__traceback__)[-1]}"
        print(f"{time.time() - start:6.2f}s {name}: {note}", flush=True)


if __name__ == "__main__":
    main()
