"""Run registered queries and their SQL checks side by side: python tests/check_oracle.py [sf] [names...]"""

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    return round(value, 9) if isinstance(value, float) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(normal(r[i]) for i in order) for r in rows], key=repr), sorted(names)


def compare(spark, sf, name, fn, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    start = time.time()
    frame = fn(spark, sf)
    got, names = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    took = time.time() - start
    cursor = con.execute(sql)
    want, other = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    same = names == other and len(got) == len(want) and all(repr(a) == repr(b) for a, b in zip(got, want))
    detail = ""
    if not same:
        bad = next(((a, b) for a, b in zip(got, want) if repr(a) != repr(b)), None)
        detail = f"columns {names} / {other}; rows {len(got)} / {len(want)}; first difference {str(bad)[:900]}"
    return same, took, len(got), detail


if __name__ == "__main__":
    import __spark_entry__ as e
    from dumplake.session import local_session

    args = sys.argv[1:]
    sf = f"/root/testdata/{args[0] if args else 'sf0.01'}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    bad = []
    for name, fn in e.queries().items():
        if args[1:] and name not in args[1:]:
            continue
        try:
            same, took, n, detail = compare(spark, sf, name, fn, e.oracle_sql()[name])
        except Exception as problem:
            same, took, n, detail = False, 0, 0, f"{type(problem).__name__}: {str(problem)[:1500]}"
        print(f"{'ok ' if same else 'BAD'} {name:28s} {took:6.2f}s {n:7d} {detail}", flush=True)
        bad += [] if same else [name]
    print("bad:", bad)
