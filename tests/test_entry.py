import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["term", "chi2"] and len(rows) == 20


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
