import __spark_entry__ as entry


def test_registered_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
