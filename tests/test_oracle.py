"""Every registered query against its DuckDB oracle (row count, column names,
column types and the multiset of values); queries without an oracle must run
and return rows."""

import pytest

from runlens.plans import load_all
from runlens.plans.compare import compare

QUERIES, ORACLE = load_all()


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k in ORACLE))
def test_query_matches_oracle(spark, duck, sf_dir, name):
    res = compare(QUERIES[name](spark, sf_dir), duck, ORACLE[name])
    assert res["columns_match"], res
    assert res["spark_rows"] == res["oracle_rows"], res
    assert res["match"], res
    assert "type_mismatch" not in res, res


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k not in ORACLE))
def test_query_without_oracle_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["run_name", "best_epoch", "best_metric", "last_delta", "status"]
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
