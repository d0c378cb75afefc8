"""Session settings, shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "seqweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    AQE splits hot join partitions at run time; `forceOptimizeSkewedJoin` lets it do so even when an
    extra shuffle follows.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Where it is unset, a local master gets a temporary folder; on a real cluster a machine-local
    folder would be lost with its executor, so the missing setting is an error there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` once as a table in the shared folder and continue from there.

    Used where a value must be computed exactly once (positions in a sorted table) and between rounds of
    iterative operators. The result is an ordinary Parquet scan: lost executors re-read files, later steps
    prune columns, and the optimizer starts from a leaf (a checkpointed plan would drag its inferred
    constraints from round to round until planning dominates). The shuffle files of the write go with its end;
    by default they would stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    before = spark.conf.get(_SHUFFLE_CLEANUP, "false")
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def release(*tables: DataFrame | None) -> None:
    """Delete tables that `materialise` wrote, once what was made of them has been written itself.

    Anything still to be computed from them would fail, so only results of `materialise` that have been replaced by
    another are given here; other frames and None are left alone.
    """
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path:
            sc = table.sparkSession.sparkContext
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame, target: int | None = None) -> DataFrame:
    """Rebalance an input that arrives in fewer partitions than there are cores.

    A table of many files passes through unchanged; only a small file read as one split is dealt out
    before an exploding operator.
    """
    target = target or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df
