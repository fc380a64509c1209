"""The statement schema shared by every scan, operator and sink."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

STATEMENT_COLUMNS = ["s_kind", "s", "p", "o_kind", "o", "o_dt", "o_lang", "g"]
STATEMENT_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in STATEMENT_COLUMNS])


def sql_text(value: str) -> str:
    """A text as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def statement_columns(fields: Mapping[str, str]) -> list[str]:
    """SQL of the statement columns; fields that are left out are NULL."""
    return [f"{fields.get(name, 'CAST(NULL AS STRING)')} AS {name}" for name in STATEMENT_COLUMNS]


def statement_sql(fields: Mapping[str, str]) -> str:
    """SQL of a statement struct; fields that are left out are NULL."""
    parts = [f"'{name}', {fields.get(name, 'CAST(NULL AS STRING)')}" for name in STATEMENT_COLUMNS]
    return f"named_struct({', '.join(parts)})"


def complete(frame: DataFrame) -> DataFrame:
    """Drop rows that lack a subject, predicate or object: no term, no statement."""
    return frame.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")


def no_statements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATEMENT_SCHEMA)
