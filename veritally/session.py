"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "veritally", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster passes its own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("VERITALLY_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, from `spark.checkpoint.dir`.

    In local mode alone (tests, a laptop) an absent setting is filled with a new folder, which
    later calls in the same session agree on. On a cluster it is an error: every executor would
    write to its own disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not configured and master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="veritally-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused, so never overwritten."""
    return f"{shared_dir(spark)}/veritally/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a stage to the shared folder and read it back.

    Used after work that must not run twice (judge calls). The written table survives the
    loss of any executor, which a cached or locally checkpointed one does not.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
