import __spark_entry__ as entry


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "inspect_stats" in entry.queries()


def test_flagship(spark):
    assert entry.entry(spark).columns == ["num_examples", "avg_turns", "avg_assistant_tokens", "max_tokens"]
