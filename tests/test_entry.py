"""Driver contract of __spark_entry__: entry, queries and oracle_sql agree."""

import re

import __spark_entry__ as E


def _own(names):
    """Without the optional training-data queries."""
    return {n for n in names if n != "pipeline" and not re.match(r"op\d+_", n)}


def test_every_query_has_oracle_sql():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert _own(qs) == _own(sql)
    for name in _own(qs):
        assert re.fullmatch(r"[a-z][a-z0-9_]*", name)


def test_entry_schema_is_the_flagship(spark):
    df = E.entry(spark)
    assert df.columns == ["label", "precision", "recall", "f1", "support", "predicted", "tp"]
    assert df.count() == 10
