"""Local correctness gate: run each registered query on Spark and its DuckDB
oracle on the same Parquet files, then compare names, types, row counts and an
order-insensitive hash of the values (the same kind of check the driver runs).

    python tools/oracle_check.py [--sf /root/testdata/sf0.01] [name-or-group ...]
"""

from __future__ import annotations

import argparse
import hashlib
import os
import sys
import time

import duckdb
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(tbl: pa.Table):
    cols = sorted(tbl.column_names)
    tbl = tbl.select(cols)
    types = {c: str(tbl.schema.field(c).type) for c in cols}
    rows = [tuple(r[c] for c in cols) for r in tbl.to_pylist()]
    def key(r):
        return tuple((v is None, str(type(v)), repr(v)) for v in r)
    rows.sort(key=key)
    h = hashlib.sha256(repr(rows).encode()).hexdigest()[:16]
    return cols, types, rows, h


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from orderscope.registry import load_all
    from orderscope.session import build_session
    reg = load_all()
    sel = [e for e in reg.values()
           if not a.names or e.name in a.names or e.group in a.names]
    spark = build_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        p = f"{a.sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    bad = 0
    for e in sel:
        t0 = time.time()
        try:
            sp = e.run(spark, a.sf).toArrow()
        except Exception as ex:  # noqa: BLE001
            print(f"FAIL  {e.name:32s} spark error: {str(ex)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = e.oracle()
        if sql is None:
            print(f"rows  {e.name:32s} {sp.num_rows:8d} rows  spark {ts:5.1f}s (no oracle)")
            continue
        try:
            dk = con.sql(sql).to_arrow_table()
        except Exception as ex:  # noqa: BLE001
            print(f"FAIL  {e.name:32s} duckdb error: {str(ex)[:600]}")
            bad += 1
            continue
        sc, st, sr, sh = norm(sp)
        dc, dt, dr, dh = norm(dk)
        ok = sc == dc and len(sr) == len(dr) and sh == dh
        status = "ok   " if ok else "FAIL "
        msg = ""
        if sc != dc:
            msg = f"cols spark={sc} duck={dc}"
        elif len(sr) != len(dr):
            msg = f"rows spark={len(sr)} duck={len(dr)}"
        elif sh != dh:
            for x, y in zip(sr, dr):
                if x != y:
                    msg = f"first diff spark={x} duck={y}"
                    break
        tmis = {c: (st[c], dt.get(c)) for c in sc if c in dt and st[c] != dt[c]}
        if tmis:
            msg += f" types {tmis}"
        if not ok:
            bad += 1
        print(f"{status} {e.name:32s} {len(sr):8d} rows  spark {ts:5.1f}s {msg[:700]}")
    print(f"{len(sel) - bad}/{len(sel)} passed")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
