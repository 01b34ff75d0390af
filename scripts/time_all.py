"""Time every registered query once (noop sink) at a scale factor."""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from runlens.plans import load_all  # noqa: E402
from runlens.session import get_spark  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
prefixes = sys.argv[2:]
q, _ = load_all()
spark = get_spark()
for name, fn in q.items():
    if prefixes and not any(name.startswith(p) for p in prefixes):
        continue
    t = time.time()
    try:
        fn(spark, sf).write.format("noop").mode("overwrite").save()
        print(f"{name} {time.time() - t:.2f}", flush=True)
    except Exception as e:
        print(f"{name} ERROR {type(e).__name__}: {str(e)[:300]}", flush=True)
