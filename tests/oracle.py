"""Compare a query with its SQL twin: columns by name, rows in any order."""

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)]

    def cell(x):
        if x is None or (isinstance(x, float) and x != x) or x is pd.NA or x is pd.NaT:
            return ("null",)
        if isinstance(x, float) and x == int(x) and abs(x) < 1e15:
            return int(x)
        return x if not isinstance(x, (list, tuple)) else tuple(x)

    rows = [tuple(cell(x) for x in row) for row in frame.itertuples(index=False, name=None)]
    return list(frame.columns), sorted(rows, key=repr)


def compare(spark, con, fn, sql, sf_dir):
    """Empty string when equal, else what differs."""
    got = normal(fn(spark, sf_dir).toPandas())
    cur = con.execute(sql)
    want = normal(pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description]))
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if diff:
        return f"{len(diff)} of {len(got[1])} rows differ, first: {str(diff[0])[:600]}"
    if not got[1]:
        return "no rows"
    return ""


def main(sf_dir, names):
    from geopulse.queries import ORACLES, QUERIES
    from geopulse.session import build_session

    spark = build_session("check", "local[8]", 8, spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            if name in ORACLES:
                note = compare(spark, con, QUERIES[name], ORACLES[name], sf_dir)
            else:
                n = QUERIES[name](spark, sf_dir).count()
                note = "" if n else "no rows"
        except Exception as e:  # report and go on with the next query
            note = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(note)
        print(f"{'FAIL' if note else 'ok'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
