"""Compare registered queries with their DuckDB oracles: ``python tests/oracle_check.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, sf_dir):
    import __spark_entry__ as entry

    t0 = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cols, got = table(df.columns, got_rows)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows={len(got)} (no oracle)", t1 - t0, True
    res = con.execute(sql)
    ocols, want = table([d[0] for d in res.description], res.fetchall())
    if cols != ocols:
        return f"COLUMNS {set(cols) ^ set(ocols)}", t1 - t0, False
    if len(got) != len(want):
        return f"ROWS {len(got)} vs {len(want)}", t1 - t0, False
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    types = [(type(a).__name__, type(b).__name__) for a, b in zip(got[0], want[0])] if got else []
    odd = [(c, *t) for c, t in zip(cols, types) if t[0] != t[1] and "NoneType" not in t]
    if bad:
        return f"VALUES {len(bad)}/{len(got)}: {cols} {bad[0][0]} | {bad[0][1]}"[:900], t1 - t0, False
    return f"rows={len(got)}" + (f" TYPES {odd}" if odd else ""), t1 - t0, True


def main():
    from hypnolake.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    import __spark_entry__ as entry

    if os.environ.get("HOT"):  # force the hot-recording and large-group paths on small data
        from hypnolake.operators import ordered, ranks

        ordered.HOT_ROWS = 20
    want = sys.argv[2:]
    names = [n for n in entry.queries() if not want or any(w in n for w in want)]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    fails = 0
    for n in names:
        try:
            msg, sec, ok = compare(spark, con, n, sf_dir)
        except Exception as e:  # noqa: BLE001
            msg, sec, ok = f"ERROR {type(e).__name__}: {str(e)[:700]}", 0, False
        fails += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n:40s} {sec:6.2f}s {msg}", flush=True)
    print(f"{len(names)} queries, {fails} failures")
    spark.stop()
    return fails


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
