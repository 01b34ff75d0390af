import os

# small matrix products lose by threads, here as in Spark's Python workers
os.environ.setdefault("OMP_NUM_THREADS", "1")
