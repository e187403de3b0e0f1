"""Compare registered queries with their SQL on one data folder: `python tests/check.py [names]`."""

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    """Values as comparable text; whole floats and ints alike."""
    if v is None or v != v:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}" if abs(v) < 1e15 else str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, sql, con):
    """None when equal, else a short report."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        only_got, only_want = got[1] - want[1], want[1] - got[1]
        return (
            f"{sum(got[1].values())} vs {sum(want[1].values())} rows, {sum(only_got.values())} differ\n"
            f"  {got[0]}\n  spark {sorted(only_got)[:2]}\n  sql   {sorted(only_want)[:2]}"
        )
    if not got[1]:
        return "no rows"
    return None


if __name__ == "__main__":
    from touchline.session import local_session
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    names = [a for a in sys.argv[1:] if not a.startswith("/")]
    folder = next((a for a in sys.argv[1:] if a.startswith("/")), folder)
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            report = compare(df, oracles[name], con) if name in oracles else (None if df.take(1) else "no rows")
        except Exception as e:
            report = f"{type(e).__name__}: {str(e)[:600]}"
        bad += report is not None
        kind = "" if name in oracles else " (rows only)"
        print(f"{'ok ' if report is None else 'BAD'} {name}{kind} {time.time() - start:.2f}s {report or ''}", flush=True)
    print(f"{bad} bad")
