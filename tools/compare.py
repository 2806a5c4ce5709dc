"""Run queries on Spark and their SQL texts on DuckDB and compare the rows.

    python tools/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from riskloom.catalog import ORACLES, QUERIES  # noqa: E402
from riskloom.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None or isinstance(a, str) or isinstance(b, str):
            return a == b
        return a == b
    return a == b


def oracle_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def compare(names_a, a, names_b, b) -> str:
    if sorted(names_a) != sorted(names_b):
        return f"columns differ: {sorted(set(names_a) ^ set(names_b))}"
    if len(a) != len(b):
        return f"row counts differ: {len(a)} and {len(b)}"
    names = sorted(names_a)
    for x, y in zip(rows_of(names_a, a), rows_of(names_b, b)):
        for n, u, v in zip(names, x, y):
            if not same(u, v):
                return f"{n}: {u!r} and {v!r} in {dict(zip(names, x))}"
    return ""


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, folder)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - t
            if name in ORACLES:
                msg = compare(df.columns, got, *oracle_rows(con, ORACLES[name]))
            else:
                msg = "" if got else "no rows"
            print(f"{'ok ' if not msg else 'BAD'} {name:28s} {len(got):7d} rows {took:6.2f}s {'' if name in ORACLES else '(rows only)'} {msg[:600]}", flush=True)
            bad += bool(msg)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR {name:28s} {type(e).__name__}: {str(e)[:700]}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
