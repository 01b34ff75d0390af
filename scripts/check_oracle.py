"""Run registered queries on Spark and their oracle SQL on DuckDB; print a
line per query. Usage: python scripts/check_oracle.py [sf_dir] [name-prefix...]"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from runlens.plans import load_all  # noqa: E402
from runlens.plans.compare import compare, duckdb_connect  # noqa: E402
from runlens.session import get_spark  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    queries, oracle = load_all()
    spark = get_spark()
    con = duckdb_connect(sf)
    bad = 0
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in oracle:
                res = compare(df, con, oracle[name])
            else:
                res = {"spark_rows": df.count(), "match": None}
        except Exception as e:  # report and continue
            res = {"error": f"{type(e).__name__}: {str(e)[:400]}", "match": False}
        res["sec"] = round(time.time() - t, 2)
        bad += res.get("match") is False
        print(name, json.dumps(res, default=str), flush=True)
    print("FAILED", bad)


if __name__ == "__main__":
    main()
