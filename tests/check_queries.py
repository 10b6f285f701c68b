"""Run registered queries against their SQL: python tests/check_queries.py [sf] [name or module ...]"""

import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

import __spark_entry__ as entry  # noqa: E402
from corpusqa.session import local_session  # noqa: E402
from oracle import connect, duck_rows, spark_rows  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted and fn.__module__.split(".")[-1] not in wanted:
            continue
        try:
            t0 = time.time()
            columns, got = spark_rows(fn(spark, sf_dir))
            t1 = time.time()
            if name not in oracles:
                print(f"rows {name} {len(got)} {t1 - t0:.1f}s", flush=True)
                continue
            sql_columns, want = duck_rows(con, oracles[name])
            t2 = time.time()
            ok = columns == sql_columns and got == want and len(got) > 0
            print(f"{'ok  ' if ok else 'FAIL'} {name} {len(got)}/{len(want)} {t1 - t0:.1f}s sql {t2 - t1:.1f}s", flush=True)
            if not ok:
                bad += 1
                print("   ", columns, sql_columns)
                diff = [(a, b) for a, b in zip(got, want) if a != b][:2]
                for a, b in diff:
                    print("    got ", repr(a)[:700])
                    print("    want", repr(b)[:700])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name} {type(e).__name__}: {str(e)[:600]}", flush=True)
    print("failures:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
