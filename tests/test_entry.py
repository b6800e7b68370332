import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert "health_score" in df.columns
    assert df.count() > 0


def test_oracle_keys_are_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 70
    # the training-data queries, the pipeline among them, come and go together
    assert ("pipeline" in q) == any(name.startswith("op1_") for name in q)
