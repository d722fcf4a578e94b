"""Command line: python tests/check.py [sf] [name-part ...] runs queries against their SQL texts."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harness import TIMES, difference  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from rasterlake.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
parts = sys.argv[2:]
spark = local_session()
spark.sparkContext.setLogLevel("ERROR")
folder = f"/root/testdata/sf{sf}"
checks = entry.oracle_sql()
failed = 0
for name, fn in entry.queries().items():
    if parts and not any(p in name for p in parts):
        continue
    started = time.time()
    try:
        df = fn(spark, folder)
        problem = difference(df, folder, checks[name]) if name in checks else f"[no sql] {df.count()} rows"
        ok = problem is None or problem.startswith("[no sql]")
    except Exception as error:  # noqa: BLE001
        problem, ok = f"{type(error).__name__}: {str(error)[:900]}", False
    failed += not ok
    print(f"\n{'ok  ' if ok else 'FAIL'} {name} {time.time() - started:.1f}s (spark {TIMES[0]:.1f} sql {TIMES[1]:.1f}) {problem or ''}", flush=True)
print("failed:", failed)
