"""Input and staging helpers of the subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from labelscope.session import ensure_checkpoint_dir

__all__ = ["discard", "ensure_checkpoint_dir", "own_name", "stage_table", "table", "tidy_shuffles"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_table(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and a
    lost executor reads files again instead of computing upstream stages."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/labelscope-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out._staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing will read again (others are left alone)."""
    for df in tables:
        path = df.__dict__.get("_staged_path")
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def own_name(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column of ``taken`` has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def tidy_shuffles(spark: SparkSession) -> None:
    """Have Spark remove a query's shuffle files when the query is done, unless
    the session says otherwise: operators of several jobs stage what they keep."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if spark.conf.get(name, "false") == "false" and not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, "true")
