"""Plan shape guards: one scan per source where the algorithm allows, column
pruning at the scan, no broadcast of data-sized tables."""

import collections
import re

import pytest
from conftest import SF_SMALL

from labelscope.plans import queries as Q

# scans per table in the final plan of each query.
EXPECTED_SCANS = {
    "per_class_prf": {"embeddings": 1},
    "classification_report": {"embeddings": 1},
    "metrics_record": {"embeddings": 1},
    "class_weights_inverse": {"documents": 1},
    "label_distribution": {"documents": 1},
    "corpus_profile": {},                     # folds the staged counts
    "history_series": {"events": 1},
    "accuracy_by_generator": {"documents": 1, "labels": 1},
    "submission_first_failure": {"lineitem": 1},
    "sample_exact_n": {"orders": 2},          # bucket counts, then rank
    "encode_fixed_length": {"documents": 1},  # the vocabulary is staged
    "balance_majority": {},                   # R3 reads the staged sample only
}


def _plan(spark, name):
    df = Q.QUERIES[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(EXPECTED_SCANS))
def test_scans_per_source(spark, name):
    plan = _plan(spark, name)
    scans = collections.Counter(re.findall(r"sf0\.001/(\w+)\.parquet", plan))
    assert dict(scans) == EXPECTED_SCANS[name]


def test_text_not_read_where_unused(spark):
    for name in ("accuracy_by_generator", "label_distribution", "class_weights_inverse"):
        schemas = re.findall(r"ReadSchema: (struct<[^\n]*)", _plan(spark, name))
        assert schemas and not any("text:" in s for s in schemas), (name, schemas)
