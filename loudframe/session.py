"""Session helpers: local sessions for tests and the place for durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "loudframe", cpus: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Read from the session; only a local session without one gets a temporary folder,
    because a folder of one machine cannot be read by the others.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        known = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of a DataFrame at a reliable checkpoint that survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
