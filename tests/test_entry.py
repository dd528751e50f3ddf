import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["engine", "priority", "issues", "errors", "files", "max_risk"]
    assert df.count() > 0


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
