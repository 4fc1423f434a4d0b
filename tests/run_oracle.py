"""python tests/run_oracle.py [sf_dir] [name prefix]: run registered queries against DuckDB and print a line for each."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from sparkscrub.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    prefixes = tuple(sys.argv[2].split(",")) if len(sys.argv) > 2 else ("",)
    spark, con = local_session(os.environ.get("CORES", "8")), connect(sf_dir)
    oracle = entry.oracle_sql()
    good = bad = 0
    for name, function in entry.queries().items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = function(spark, sf_dir)
            problem = compare(df, con, oracle[name]) if name in oracle else f"(rows only: {df.count()})"
        except Exception as error:  # noqa: BLE001 - a report line per query
            problem = "ERROR " + "".join(traceback.format_exception_only(error))[:600]
        fine = not problem or problem.startswith("(rows")
        good, bad = good + fine, bad + (not fine)
        print(f"RESULT {'ok ' if fine else 'BAD'} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"RESULT total good={good} bad={bad}")
