"""Driver contract: entry() runs, every oracle has a query."""
import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "LIX" in df.columns


def test_registry_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert "a31_feature_table" in o and "e11_error_feature_table" in o
