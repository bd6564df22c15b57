"""Every registered query against its DuckDB oracle on sf0.001."""

import re

from conftest import SF_SMALL
from oracle_compare import compare


def test_all_queries_match_oracle(spark):
    import __spark_entry__ as E

    # the optional training-data queries have tests of their own
    names = [n for n in E.queries() if n != "train_classifier" and n != "pipeline" and not re.match(r"op\d+_", n)]
    res = compare(spark, SF_SMALL, names, verbose=False)
    bad = {k: v for k, v in res.items() if v[0] != "ok"}
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() == 10 and "f1" in df.columns
