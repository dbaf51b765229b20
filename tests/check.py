"""python tests/check.py [sf] [name prefix ...]: compare queries with their SQL."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import connect, differences

import __spark_entry__ as entry
from tidemark.session import local_session

sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
wanted = sys.argv[2:]
sf_dir = f"/root/testdata/sf{sf}"
spark = local_session()
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf_dir)
sqls = entry.oracle_sql()
failed = []
for name, fn in entry.queries().items():
    if wanted and not any(name.startswith(w) for w in wanted):
        continue
    start = time.time()
    try:
        if name in sqls:
            problem = differences(fn(spark, sf_dir), con, sqls[name])
        else:
            problem = None if len(fn(spark, sf_dir).collect()) else "no rows"
    except Exception as e:
        problem = f"{type(e).__name__}: {str(e)[:1500]}"
    print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {name}"
          f"{'' if name in sqls else ' (rows only)'}{'' if problem is None else ' - ' + problem}", flush=True)
    if problem:
        failed.append(name)
print("failed:", failed)
