"""python tests/run_oracles.py [NAME...]: runs queries at sf0.01 and compares those that have SQL; seconds of each."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry
from oracle import compare, connect
from strandloom.session import local_session

FOLDER = "/root/testdata/sf0.01"

if __name__ == "__main__":
    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql, con = entry.queries(), entry.oracle_sql(), connect(FOLDER)
    bad = []
    for name in [n for n in queries if not sys.argv[1:] or any(n.startswith(a) for a in sys.argv[1:])]:
        t = time.time()
        try:
            df = queries[name](spark, FOLDER)
            said = compare(df, sql[name], con) if name in sql else f"no SQL; {df.count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        if said and not said.startswith("no SQL"):
            bad.append(name)
        print(f"{name}: {said or 'equal'} ({time.time() - t:.1f} s)", flush=True)
    print("BAD", bad)
