"""Streaming jobs. A mapping compiles to the same plan for bounded and unbounded sources, so what is
left here is starting and stopping the query."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadweave.errors import FormatError
from quadweave.operators import rendering
from quadweave.operators.schema import STATEMENT_COLUMNS
from quadweave.plans.output import output_format
from quadweave.sinks.text import WriteReport, write_at


def stream_lines(statements: DataFrame, fmt: str = "nq") -> DataFrame:
    """Statement lines of a stream. Files may be cut anywhere, so IRIs are written in full."""
    lines = {
        "nt": rendering.ntriples_line,
        "nq": rendering.nquads_line,
        "ttl": rendering.turtle_line,
        "ttls": rendering.turtle_line,
        "n3": rendering.turtle_line,
        "trig": rendering.trig_line,
        "trigs": rendering.trig_line,
        "trix": None,
    }
    line = lines.get(output_format(fmt))
    if line is None:
        raise FormatError(f"'{fmt}' cannot be written statement by statement to a growing set of files")
    return statements.select(line().alias("value"))


def start_line_sink(
    statements: DataFrame, path: str, checkpoint: str, fmt: str = "nq", *, trigger: dict | None = None
) -> StreamingQuery:
    """Append statement lines to files, exactly once; restarting with the checkpoint resumes."""
    writer = stream_lines(statements, fmt).writeStream.format("text").outputMode("append")
    return _start(writer, path, checkpoint, trigger)


def start_statement_sink(
    statements: DataFrame, path: str, checkpoint: str, *, trigger: dict | None = None
) -> StreamingQuery:
    """Append statements as a Parquet table, for queries over what has arrived so far."""
    writer = statements.select(*STATEMENT_COLUMNS).writeStream.format("parquet").outputMode("append")
    return _start(writer, path, checkpoint, trigger)


def start_dataset_sink(
    statements: DataFrame,
    path: str,
    checkpoint: str,
    fmt: str = "nq",
    *,
    prefixes: Mapping[str, str] | None = None,
    pretty: bool = False,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write each micro-batch as a dataset of its own, in any output format, with prefixes, below ``path/batch=<number>``.

    A batch that is run again after a failure replaces its folder, so every batch is there once; its counts are
    kept beside it (see ``written_so_far``). Grouped formats are sets within a batch, not between batches.
    """
    output_format(fmt)
    root = path.rstrip("/")

    def write(batch: DataFrame, number: int) -> None:
        report = write_at(batch, f"{root}/batch={number}", fmt, prefixes=prefixes, pretty=pretty)
        counts = batch.sparkSession.createDataFrame(
            [(report.written_raw, report.written_distinct)], "written_raw bigint, written_distinct bigint"
        )
        counts.coalesce(1).write.mode("overwrite").json(f"{root}/_counts/batch={number}")

    writer = statements.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def written_so_far(spark: SparkSession, path: str) -> WriteReport:
    """What a dataset sink has written in all its finished batches, restarts included; copies between batches count each time."""
    counts = spark.read.schema("written_raw bigint, written_distinct bigint").json(f"{path.rstrip('/')}/_counts/batch=*")
    raw, distinct = counts.agg(F.coalesce(F.sum("written_raw"), F.lit(0)), F.sum("written_distinct")).first()
    return WriteReport(path, raw, distinct)


def _start(writer, path: str, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)
