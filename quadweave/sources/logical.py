"""Logical sources: each becomes a flat DataFrame with one column per reference of the mapping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.errors import SourceError
from quadweave.model import Source
from quadweave.sources import json_paths, lexed, xml_paths


def resolve_location(name: str, root: str | None) -> str:
    """A source name under its root; absolute paths and URIs stay as they are."""
    if root is None or name.startswith("/") or "://" in name:
        return name
    return root.rstrip("/") + "/" + name


def load_source(
    spark: SparkSession,
    source: Source,
    references: Sequence[str],
    bindings: Mapping[str | None, DataFrame],
    root: str | None,
) -> DataFrame:
    """Bound DataFrames win over locations, so any table or stream can stand in for a file."""
    if source.name in bindings:
        return _bound(bindings[source.name], source, references)
    if source.name is None:
        raise SourceError("the mapping reads the unnamed input, but no DataFrame is bound to None")
    if source.formulation == "table":
        raise SourceError(f"no DataFrame is bound to the source '{source.name}'")
    path = resolve_location(source.name, root)
    if source.formulation == "csv":
        return _pick(read_csv(spark, path, dict(source.options)), references)
    if source.formulation == "json":
        return json_paths.read_json(spark, path, source.iterator or "$", references, dict(source.options))
    if source.formulation == "xml":
        return xml_paths.read_xml(spark, path, source.iterator, references, dict(source.options))
    raise SourceError(f"unknown reference formulation '{source.formulation}'")


def _bound(frame: DataFrame, source: Source, references: Sequence[str]) -> DataFrame:
    known = set(frame.columns)
    if source.formulation == "json" and (source.column or not set(references) <= known):
        column = source.column or "value"
        if column not in known:
            raise SourceError(f"the bound input has no column '{column}' with JSON text")
        types = dict(dict(source.options).get("types", ()))
        return json_paths.expand_json(frame, column, source.iterator or "$", references, types)
    if source.formulation == "xml" and not set(references) <= known:
        if "value" not in known:
            raise SourceError("the bound input has no column 'value' with XML text")
        return xml_paths.expand_xml(frame, "value", source.iterator, references)
    return _pick(frame, references)


def _pick(frame: DataFrame, references: Sequence[str]) -> DataFrame:
    """One column per reference: a column of that name, else a dotted path into nested columns."""
    known = set(frame.columns)
    if set(references) <= known:
        return frame  # unused columns never leave the scan anyway
    columns = []
    for name in references:
        column = F.col(f"`{name}`") if name in known else F.col(name)
        if name not in known and name.split(".")[0] not in known:
            raise SourceError(f"the source has no reference '{name}'; it has {sorted(known)}")
        columns.append(column.alias(name))
    return frame.select(*columns)


#: Options of CSV sources that readers of single records know as well.
SPLITTABLE_OPTIONS = {"sep", "delimiter", "mode"}


def read_csv(spark: SparkSession, path: str, options: dict[str, object] | None = None) -> DataFrame:
    """CSV with a header row, every value as text.

    Quoted line breaks are legal: a first pass over the files finds for every task whether its share starts inside a
    quoted field (see ``lexed``), a second one takes the records apart. ``multi_line=False`` says that there are none and
    saves the first pass. With reader options beyond a separator and a mode, a file is one task's. Rows end with a line
    feed, alone or after a carriage return. An empty field is an empty text, unless ``null_value`` names the text
    that stands for a missing value. A row with too few or too many fields is an error, unless the option ``mode`` says
    otherwise.
    """
    options = dict(options or {})
    null_value = options.pop("null_value", None)
    multi_line = options.pop("multi_line", True)
    settings = {
        "quote": '"',
        "escape": '"',
        "multiLine": multi_line,
        "nullValue": "\u0000" if null_value is None else null_value,
        "emptyValue": "",
        "mode": "FAILFAST",
        **options,
    }
    frame = spark.read.options(header=True, inferSchema=False, **settings).csv(path)
    separator = str(options.get("sep", options.get("delimiter", ",")))
    single = set(options) <= SPLITTABLE_OPTIONS and len(separator) == 1 and settings["mode"] in ("FAILFAST", "PERMISSIVE")
    if multi_line and single and frame.columns:
        frame = _split_csv(spark, path, frame.columns, separator, settings)
    if null_value is None:
        quoted = [(name, name.replace("`", "``")) for name in frame.columns]
        frame = frame.select(*[F.coalesce(F.col(f"`{column}`"), F.lit("")).alias(name) for name, column in quoted])
    return frame


def _split_csv(spark: SparkSession, path: str, names: list[str], separator: str, settings: dict[str, object]) -> DataFrame:
    records = lexed.read_records(spark, [path], lexed.csv_lexer(separator))
    rows = records.where("NOT (block = 0 AND number = 0)").select(F.regexp_replace("value", "\r$", "").alias("value"))
    escaped = [name.replace("`", "``") for name in names]
    schema = ", ".join(f"`{name}` string" for name in escaped)
    parsed = F.from_csv("value", schema, {name: str(value) for name, value in settings.items()})
    # The generator keeps filters on parsed values above it; below, they would parse once more each.
    fields = rows.where("value <> ''").select(F.explode(F.array(parsed)).alias("_csv"))
    return fields.select(*[F.col(f"_csv.`{name}`") for name in escaped])
