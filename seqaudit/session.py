"""Session settings and the few runtime helpers every operator shares."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "seqaudit", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the cluster's shared checkpoint folder.

    A machine-local folder is used only in local mode, where driver and executors
    are one process; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="seqaudit-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")


def cut(df: DataFrame) -> DataFrame:
    """Materialise on shared storage and drop the lineage (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """Like ``cut``, through Parquet files in the checkpoint folder: for tables that are read again, narrow ones above all.

    A checkpoint keeps the size its plan was estimated at, and the estimate of a join is the product of its sides. In
    a loop that number triples its digits each round and fills the driver; files are taken at their own size.
    """
    if not df.columns or len({c.lower() for c in df.columns}) < len(df.columns) or "void" in df.schema.simpleString():
        return cut(df)  # no table that Parquet can hold
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)  # bases are hardly packed by the default codec
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    spark = df.sparkSession
    root = f"{spark.sparkContext.getCheckpointDir()}/settled-"
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("settled-") and path.toUri().getPath().startswith(
                spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that no table reads any more: Spark deletes them once their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a scan that has fewer files than task slots.

    A large table already has more files than slots, so nothing is shuffled there.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= slots:
        return df
    return df.repartition(slots, *keys)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))
