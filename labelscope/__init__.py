"""labelscope: Spark-native label balancing, scoring and evaluation.

Every public operator takes and returns a Spark DataFrame. Work stays on the
executors: aggregates are partial/final hash aggregations, rankings are
bucketed so a hot class never lands in one task, and small dimension tables
are broadcast only when their size is bounded by a parameter.
"""

from labelscope.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
