"""Compare registered queries with their SQL counterpart in DuckDB, the way the driver does."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, name, fn, sql, sf_dir, show=4):
    t = time.time()
    df = fn(spark, sf_dir)
    got, gcols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t
    if sql is None:
        return f"ROWS {name:32s} {len(got):7d} rows {spent:6.1f}s", True
    cur = con.execute(sql)
    want, wcols = rows_of([d[0] for d in cur.description], cur.fetchall())
    ok = got == want and gcols == wcols
    line = f"{'OK  ' if ok else 'FAIL'} {name:32s} {len(got):7d} rows {spent:6.1f}s"
    if not ok:
        line += f"\n   cols spark {gcols}\n   cols sql   {wcols}\n   rows {len(got)} vs {len(want)}"
        a, b = set(got), set(want)
        for r in list(sorted(a - b))[:show]:
            line += f"\n   + {str(r)[:400]}"
        for r in list(sorted(b - a))[:show]:
            line += f"\n   - {str(r)[:400]}"
    return line, ok


def main(argv):
    from pyspark.sql import SparkSession

    from attesta.queries import load

    sf = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    for a in argv:
        if a.startswith("/"):
            sf = a
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    q, s = load()
    bad = 0
    for n, fn in q.items():
        if names and not any(n.startswith(x) for x in names):
            continue
        try:
            line, ok = compare(spark, con, n, fn, s.get(n), sf)
        except Exception as ex:  # noqa: BLE001
            line, ok = f"ERR  {n}: {str(ex)[:1500]}", False
        bad += not ok
        print(line, flush=True)
    print(f"{len(q)} queries, {len(s)} with SQL, {bad} not equal", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
