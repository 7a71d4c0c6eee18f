"""python tests/check.py [sf] [name part ...] - oracle comparison report."""
import os, sys, time, traceback
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry
from tests.oracle import compare, connect
from turnweave.runtime import local_session

sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
parts = sys.argv[2:]
if os.environ.get("CHECK_PLAIN"):
    from pyspark.sql import SparkSession
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
else:
    spark = local_session(8)
con = connect(sf)
qs, os_ = entry.queries(), entry.oracle_sql()
bad = 0
for name, fn in qs.items():
    if parts and not any(p in name for p in parts):
        continue
    t = time.time()
    try:
        if name in os_:
            problems, n = compare(spark, con, sf, fn, os_[name])
        else:
            n = fn(spark, sf).toArrow().num_rows
            problems = [] if n else ["no rows"]
    except Exception as e:
        problems, n = [f"{type(e).__name__}: {str(e)[:1500]}"], -1
    bad += bool(problems)
    print(("FAIL" if problems else "ok  "), name, n, "rows", round(time.time() - t, 2), "s",
          "" if name in os_ else "[rows only]", *problems, flush=True)
print("failures:", bad)
