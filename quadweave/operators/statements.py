"""Operators on whole statement DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.operators.schema import STATEMENT_COLUMNS


def distinct(statements: DataFrame) -> DataFrame:
    """Statements as a set. Copies are merged within each task before anything is shuffled."""
    return statements.select(*STATEMENT_COLUMNS).dropDuplicates()


def distinct_within(statements: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Duplicate removal for unbounded input: copies are found as long as the watermark keeps them."""
    return statements.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(STATEMENT_COLUMNS)


def count_raw(statements: DataFrame) -> DataFrame:
    """How many statements were generated, copies included."""
    return statements.agg(F.count(F.lit(1)).alias("n"))


def count_distinct(statements: DataFrame) -> DataFrame:
    return distinct(statements).agg(F.count(F.lit(1)).alias("n"))


def count_both(statements: DataFrame) -> DataFrame:
    """Generated and distinct counts from one pass, as a set-building sink reports them."""
    copies = statements.groupBy(*STATEMENT_COLUMNS).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("written_raw"), F.count(F.lit(1)).alias("written_distinct")
    )


def drop_graphs(statements: DataFrame) -> DataFrame:
    """Merge all graphs into the default graph, as formats without graphs do."""
    return distinct(statements.withColumn("g", F.lit(None).cast("string")))


def graph_counts(statements: DataFrame) -> DataFrame:
    """Statements per graph; the default graph is NULL."""
    return statements.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
