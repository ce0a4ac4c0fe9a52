"""Run registered queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

#: Queries without rows on the smallest data set; any other empty result fails.
MAY_BE_EMPTY = {"rule_egress", "mon_spike", "mon_spike_slide", "stream_traffic_windows", "stream_port_scan_windows"}
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, build, sql, sf_dir):
    """(ok, message) of one query."""
    t0 = time.time()
    df = build(spark, sf_dir)
    got = normal(df.columns, df.collect())
    t1 = time.time()
    if sql is None:
        return len(got[1]) > 0, f"{name}: rows only, {len(got[1])} rows, spark {t1 - t0:.2f}s"
    result = con.execute(sql)
    want = normal([d[0] for d in result.description], result.fetchall())
    t2 = time.time()
    note = f"{name}: {len(got[1])} rows, spark {t1 - t0:.2f}s, duckdb {t2 - t1:.2f}s"
    if got[0] != want[0]:
        return False, f"{note}\n  columns {got[0]}\n      vs {want[0]}"
    if got[1] == want[1]:
        if not got[1] and name not in MAY_BE_EMPTY:
            return False, note + "  EMPTY"
        kinds = {c: type(v).__name__ for c, v in zip(got[0], got[1][0])} if got[1] else {}
        return True, note + ("" if got[1] else "  EMPTY") + f"  {kinds if '-v' in sys.argv else ''}"
    extra = [r for r in got[1] if r not in set(want[1])][:2] if len(got[1]) < 20000 else got[1][:2]
    missing = [r for r in want[1] if r not in set(got[1])][:2] if len(got[1]) < 20000 else want[1][:2]
    return False, f"{note}, expected {len(want[1])}\n  only spark {extra}\n  only duckdb {missing}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
    from packetloom.session import local_session

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    wanted = [a for a in sys.argv[2:] if not a.startswith("-")]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, message = compare(spark, con, name, build, sqls.get(name), sf_dir)
        except Exception as error:  # report and go on with the others
            ok, message = False, f"{name}: {type(error).__name__} {str(error)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", message, flush=True)
    print("failed:", bad)
