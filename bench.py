"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is built and run to completion into Spark's no-op sink (no
collect); one warm-up run, then the median of $BENCH_REPEATS runs. The same
query's oracle SQL is timed on DuckDB over the same Parquet files for
reference. Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_run_summary", "a01_run_profile", "a03_best_per_run", "w01_convergence", "w02_leaderboard",
    "j01_resume_anti", "j04_strategy_compare", "s05_checkpoint_catalog", "p08_stratified_split",
    "p12_fixed_length_encode", "p15_bow_counts", "v03_kl_loss", "v07_patient_loss", "v16_cosine",
    "v23_integrated_gradients", "a12_classification_report", "n07_pareto", "m05_batch_score",
    "s06_append_results", "s09_report_lines", "t01_incremental_ingest", "a15_running_best", "w07_chain_degradation",
    "p13_batch_pad", "v12_token_filter",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]

    os.environ.setdefault("RUNLENS_SHUFFLE_PARTITIONS", str(max(8, 2 * cpus)))
    from runlens.plans import load_all
    from runlens.session import get_spark

    queries, oracle = load_all()
    spark = get_spark(master=f"local[{cpus}]")

    def run_spark(name: str) -> float:
        t = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    try:
        from runlens.plans.compare import duckdb_connect
        con = duckdb_connect(sf_dir)
    except Exception:  # DuckDB is only a reference point
        con = None

    def run_duck(name: str) -> float:
        t = time.perf_counter()
        con.execute(oracle[name]).fetchall()
        return time.perf_counter() - t

    spark_sec, duck_sec, errors = {}, {}, {}
    for name in names:
        if name not in queries:
            errors[name] = "unknown query"
            continue
        try:
            run_spark(name)  # warm-up
            spark_sec[name] = round(statistics.median(run_spark(name) for _ in range(repeats)), 3)
        except Exception as e:  # keep benchmarking the others
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
            continue
        if con is not None and name in oracle:
            try:
                run_duck(name)
                duck_sec[name] = round(statistics.median(run_duck(name) for _ in range(repeats)), 3)
            except Exception as e:
                errors[f"duckdb:{name}"] = f"{type(e).__name__}: {str(e)[:200]}"

    sf = sf_dir.rsplit("sf", 1)[-1] if "sf" in os.path.basename(sf_dir) else sf_dir
    out = {"metric": "headline_queries_total_median_sec", "value": round(sum(spark_sec.values()), 3),
           "unit": "sec", "queries": spark_sec, "sf": sf, "cpus": cpus, "repeats": repeats,
           "duckdb_sec": duck_sec, "duckdb_total_sec": round(sum(duck_sec.values()), 3)}
    if errors:
        out["errors"] = errors
    print(json.dumps(out), flush=True)


if __name__ == "__main__":
    main()
