"""Shared helpers: tables in the shared folder, bitmaps of fixed size, connected components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables with at most this many rows of a few numbers may be broadcast (about 16 bytes a row).
BROADCAST_ROWS = 1 << 20
#: log2 of the bits in a bitmap that is sent to every task (4 MB, whatever the data).
BITMAP_BITS = 25
ARROW_ROWS = 1024


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path that the driver and all executors reach: below spark.checkpoint.dir, else below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def bounded(spark: SparkSession):
    """For queries that are made and run meanwhile: at most ARROW_ROWS rows, which may be whole texts or sets, in a batch
    between JVM and Python; shuffle files go when the query ends, not when the driver's garbage happens to be collected."""
    rows, clean = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, cleaned = int(spark.conf.get(rows)), spark.conf.get(clean, "false")
    spark.conf.set(rows, min(before, ARROW_ROWS) if before > 0 else ARROW_ROWS)
    spark.conf.set(clean, "true")
    try:
        yield
    finally:
        spark.conf.set(rows, before)
        spark.conf.set(clean, cleaned)


def shared_table(frame: DataFrame, purpose: str) -> DataFrame:
    """Write once, read many times: cuts the lineage, and lost executors don't lose it."""
    path = shared_folder(frame.sparkSession, purpose)
    with bounded(frame.sparkSession):
        frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def broadcast_if_small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a narrow written table if its counted rows allow it; else Spark shuffles."""
    return F.broadcast(frame) if frame.count() <= rows else frame


def bitmap(frame: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """Which values modulo 2**bits occur, as packed bits. A filter that lets too much pass, never too little.

    The driver gets at most 2**(bits - 6) rows of two numbers.
    """
    place = F.pmod(F.col(column), F.lit(1 << bits))
    with bounded(frame.sparkSession):
        words = (
            frame.select(place.alias("at"))
            .select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
            .groupBy("word")
            .agg(F.bit_or("bit").alias("bits"))
            .toArrow()
        )
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def in_bitmap(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.astype(np.uint64) & np.uint64(len(table) * 64 - 1)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b) of longs: rows (node, component), the least node of each.

    Alternating large and small stars: every round is two combined minima and joins; the hot centre of a star
    is one row on the side of the minima, and Spark splits its other side. Rounds grow with the logarithm of
    the longest path. Only a count and a checksum reach the driver.
    """
    links = shared_table(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = None
    while True:
        both = links.union(links.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        links = shared_table(small.filter("u <> v").distinct(), "links")
        now = tuple(links.agg(F.count("*"), mark).first())
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select("v", "v").distinct()
    )
