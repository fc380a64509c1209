"""Files on any file system Spark can reach, and the shared working folder of a session."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.errors import SourceError

BROADCAST_BYTES = 64 << 20


def _path(spark: SparkSession, location: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(location)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, location: str) -> list[str]:
    """Every regular file at or below a location. Only names travel to the driver."""
    path, file_system = _path(spark, location)
    try:
        if not file_system.exists(path):
            raise SourceError(f"Exception occurred while reading path {location}")
        found = []
        listing = file_system.listFiles(path, True)
        while listing.hasNext():
            found.append(listing.next().getPath().toString())
        return sorted(found)
    except PySparkException as error:
        raise SourceError(f"Exception occurred while reading path {location}") from error


def require_path(spark: SparkSession, location: str) -> None:
    path, file_system = _path(spark, location)
    if not file_system.exists(path):
        raise SourceError(f"Exception occurred while reading path {location}")


def output_location(spark: SparkSession, location: str) -> str:
    """Where to write: a directory that is no earlier output gets a child named ``output``."""
    path, file_system = _path(spark, location)
    if file_system.exists(path) and file_system.getFileStatus(path).isDirectory():
        marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
        if not file_system.exists(marker):
            return location.rstrip("/") + "/output"
    return location


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, else below the warehouse; every executor can reach either."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/quadweave-{purpose}-{uuid.uuid4().hex}"


def ensure_checkpoint_folder(spark: SparkSession) -> None:
    """Point reliable checkpoints at the shared folder, unless the session already has one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or scratch_folder(spark, "checkpoint"))


def broadcast_if_small(table: DataFrame) -> DataFrame:
    """Hint a broadcast for a checkpointed table only after its size has been measured."""
    size = F.length(F.to_json(F.struct(*table.columns)))
    measured = table.agg(F.sum(size).alias("n")).first()["n"] or 0
    return F.broadcast(table) if measured <= BROADCAST_BYTES else table
