"""Session settings shared by tests, the bench and command-line use."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "wardtable") -> SparkSession:
    """A local session for tests and the bench; on a cluster pass your own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    ``fallback`` is used only where that setting is absent (local tests); without
    one a missing setting is an error, so that no job ever relies on a folder that
    only one machine can see.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named
    if fallback is None:
        raise ValueError("spark.checkpoint.dir is not set: name a folder all executors can reach")
    return fallback


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own, not made yet, in the shared folder.

    Where ``spark.checkpoint.dir`` is unset a folder of this machine is used in local mode alone.
    """
    local = spark.sparkContext.master.startswith("local[")
    fallback = "file://" + tempfile.gettempdir() if local else None
    return f"{shared_folder(spark, fallback).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to a new folder and read back, so that its plan does not run again for every job and branch that reads it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``new_folder`` named, once nothing reads it any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
