"""Runs queries and their SQL side by side: python tests/check_oracle.py [sf] [prefix...]."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def canonical(rows, columns):
    def cell(v):
        if v is None:
            return "∅"
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) < 1e15 else repr(v)
        if isinstance(v, bool):
            return str(v)
        return str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, f, sql, d):
    df = f(spark, d)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want = cur.fetchall()
    wc = [x[0] for x in cur.description]
    if sorted(df.columns) != sorted(wc):
        return f"columns {sorted(df.columns)} / {sorted(wc)}"
    a, b = canonical(got, df.columns), canonical(want, wc)
    if a != b:
        sa, sb = set(a), set(b)
        return f"rows {len(a)} / {len(b)}; only ours {list(sa - sb)[:2]}; only theirs {list(sb - sa)[:2]}"
    return ""


def connect(d):
    import duckdb

    con = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    d = f"/root/testdata/{sf}"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracle = connect(d), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sorted(queries):
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        t = time.time()
        try:
            if name in oracle:
                why = compare(spark, con, name, queries[name], oracle[name], d)
            else:
                queries[name](spark, d).collect()
                why = ""
        except Exception as x:  # noqa: BLE001
            why = f"{type(x).__name__}: {str(x)[:600]}"
        bad += bool(why)
        print(f"{'FAIL' if why else 'ok  '} {name} {'' if name in oracle else '(no SQL) '}{time.time() - t:.1f}s {why}", flush=True)
    print("failures", bad)
