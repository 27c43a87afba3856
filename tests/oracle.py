"""Runs registered queries and their SQL side by side. python -m tests.oracle [SF_DIR] [NAME ...]"""

from __future__ import annotations

import datetime
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb


def spark_session(cpus: int = 8):
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def views(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def norm(x):
    if isinstance(x, (float, Decimal)):
        return None if isinstance(x, float) and math.isnan(x) else f"{float(x):.9g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return str([norm(y) for y in x])
    if isinstance(x, int) and not isinstance(x, bool):
        return f"{float(x):.9g}" if abs(x) < 2**50 else str(x)
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), sorted(names)


def compare(spark, con, name, query, sql, sf_dir) -> str:
    t = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    took = time.time() - t
    if sql is None:
        return f"rows {len(got)} ({took:.1f} s)"
    cur = con.execute(sql)
    want, wn = rows_of([d[0] for d in cur.description], cur.fetchall())
    have, hn = rows_of(df.columns, got)
    if hn != wn:
        return f"MISMATCH columns {hn} {wn}"
    if have != want:
        a, b = [x for x in have if x not in set(want)][:3], [x for x in want if x not in set(have)][:3]
        return f"MISMATCH {len(have)} {len(want)}: spark only {a}; sql only {b}"
    return f"ok {len(got)} ({took:.1f} s)"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as e

    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark, con = spark_session(), views(d)
    for name, q in e.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(a) for a in sys.argv[2:]):
            continue
        try:
            print(name, compare(spark, con, name, q, e.oracle_sql().get(name), d), flush=True)
        except Exception as x:  # noqa: BLE001
            print(name, "ERROR", type(x).__name__, str(x)[:1500], flush=True)
