"""JSON sources. The schema comes from the mapping's own references, so nothing is inferred.

Supported paths: ``$``, ``.name``, ``['name']``, ``[n]``, ``[*]``. Anything else is an error on the
driver, before a job starts.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadweave.errors import SourceError

#: Field of a parsed document that holds its text if it could not be read as the paths want.
UNREAD = "_unread"

Step = str | int | None  # field name, array index, or every element

_STEP = re.compile(r"\.?([^.\[\]'\"*@?()$\s]+)|\.?\['([^']+)'\]|\.?\[\"([^\"]+)\"\]|\[(\d+)\]|\.?\[?(\*)\]?")


def parse_json_path(path: str) -> list[Step]:
    rest = path.strip()
    if rest.startswith("$"):
        rest = rest[1:]
    steps: list[Step] = []
    while rest:
        match = _STEP.match(rest)
        if rest.startswith("..") or not match:
            raise SourceError(f"unsupported JSONPath '{path}': use $, .name, ['name'], [n] and [*]")
        bare, quoted, double_quoted, index, _ = match.groups()
        name = bare or quoted or double_quoted
        steps.append(name if name is not None else int(index) if index is not None else None)
        rest = rest[match.end() :]
    return steps


class _Node:
    """What the paths need to know of one place in a document."""

    def __init__(self) -> None:
        self.fields: dict[str, _Node] = {}
        self.element: _Node | None = None
        self.is_leaf = False

    def add(self, steps: Sequence[Step], path: str) -> None:
        if not steps:
            self.is_leaf = True
        elif isinstance(steps[0], str):
            self.fields.setdefault(steps[0], _Node()).add(steps[1:], path)
        else:
            self.element = self.element or _Node()
            self.element.add(steps[1:], path)
        if self.is_leaf + bool(self.fields) + bool(self.element) > 1:
            raise SourceError(f"'{path}' and another path use the same JSON value in different ways")

    def dtype(self) -> T.DataType:
        if self.element:
            return T.ArrayType(self.element.dtype())
        if self.fields:
            return T.StructType([T.StructField(name, node.dtype()) for name, node in self.fields.items()])
        return T.StringType()


def _walk(value: Column, steps: Sequence[Step]) -> tuple[Column, bool]:
    """The value at a path and whether it is an array of values."""
    for position, step in enumerate(steps):
        if isinstance(step, str):
            value = value.getField(step)
        elif isinstance(step, int):
            value = F.get(value, F.lit(step))
        else:
            rest = steps[position + 1 :]
            if not rest:
                return value, True
            nested_multi = False

            def inner(item: Column) -> Column:
                nonlocal nested_multi
                column, nested_multi = _walk(item, rest)
                return column

            nested = F.transform(value, inner)
            return (F.flatten(nested) if nested_multi else nested), True
    return value, False


def _iterate(frame: DataFrame, value: str, steps: Sequence[Step]) -> DataFrame:
    """Replace the document column by one row per match of the iterator."""
    pending = F.col(value)
    for step in steps:
        if step is None:
            others = [F.col(f"`{c}`") for c in frame.columns if c != value]
            frame = frame.select(*others, F.explode(pending).alias(value))
            pending = F.col(value)
        else:
            pending, _ = _walk(pending, [step])
    others = [F.col(f"`{c}`") for c in frame.columns if c != value]
    return frame.select(*others, pending.alias(value)).where(F.col(value).isNotNull())


def _document_type(iterator: Sequence[Step], references: dict[str, list[Step]]) -> T.DataType:
    root = _Node()
    for name, steps in references.items():
        root.add([*iterator, *steps], name)
    return root.dtype()


def _keep_number_text(text: Column) -> Column:
    """Quote fractional and very long numbers, which the parser would otherwise pass through a double.

    Text between quotes is left alone: escaped quotes and backslashes are stood in for by control
    characters, which JSON text cannot hold, so every second piece between quotes is outside strings.
    """
    masked = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\u0001")), F.lit('\\"'), F.lit("\u0002"))
    number = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"
    pieces = F.transform(
        F.split(masked, '"'),
        lambda piece, i: F.when(i % 2 == 0, F.regexp_replace(piece, number, '"$1"')).otherwise(piece),
    )
    joined = F.replace(F.array_join(pieces, '"'), F.lit("\u0002"), F.lit('\\"'))
    quoted = F.replace(joined, F.lit("\u0001"), F.lit("\\\\"))
    return F.when(text.rlike(r"[0-9]\.[0-9]|[0-9][eE]|[0-9]{19}"), quoted).otherwise(text)


def _checked(text: Column, parsed: Column, dtype: T.DataType) -> Column:
    """The parsed document. Text that is no JSON is an error; JSON of another shape than the paths want has no match."""
    odd = parsed.getField(UNREAD).isNotNull() if isinstance(dtype, T.StructType) else parsed.isNull()
    bad = text.isNotNull() & odd & F.try_parse_json(text).isNull()
    message = F.concat(F.lit("malformed JSON document: "), F.substring(text, 1, 200))
    return F.when(bad, F.raise_error(message).cast(dtype)).otherwise(parsed)


def expand_json(
    frame: DataFrame,
    column: str,
    iterator: str,
    references: Sequence[str],
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """Iterate a column of JSON text; other columns of the frame stay available as references."""
    known = set(frame.columns)
    paths = {name: parse_json_path(name) for name in references if name not in known}
    outer = [name for name in references if name in known]
    steps = parse_json_path(iterator)
    kept = [F.col(f"`{name}`") for name in outer]
    if not paths:
        paths = {"$": []}
    dtype = _document_type(steps, paths)
    if isinstance(dtype, T.StringType):
        document = F.col(f"`{column}`")
    else:
        text = F.col(f"`{column}`")
        options = {}
        if isinstance(dtype, T.StructType):
            dtype = T.StructType([*dtype.fields, T.StructField(UNREAD, T.StringType())])
            options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": UNREAD}
        parsed = F.from_json(_keep_number_text(text), dtype, options)
        document = _checked(text, parsed, dtype)
    # The generator keeps filters on parsed values above it; below, they would parse once more each.
    rows = frame.select(*kept, F.explode(F.array(document)).alias("_json"))
    return _references(_iterate(rows, "_json", steps), "_json", outer, paths, references, types)


def _references(rows: DataFrame, value: str, outer, paths, references, types) -> DataFrame:
    """One column per reference; the text of a value is cast where ``types`` wants another type."""
    columns = []
    for name in references:
        if name in outer:
            column = F.col(f"`{name}`")
        else:
            column, multi = _walk(F.col(value), paths[name])
            if types and name in types:
                column = column.cast(f"array<{types[name]}>" if multi else types[name])
        columns.append(column.alias(name))
    return rows.select(*columns)


def read_json(
    spark: SparkSession, path: str, iterator: str, references: Sequence[str], options: dict[str, object]
) -> DataFrame:
    """JSON files, one document each; ``lines=True`` reads one document per line and splits files.

    Values are text unless ``types`` gives a reference a Spark SQL type, which then also decides the
    natural datatype of its literals.
    """
    lines = bool(options.pop("lines", False))
    types = dict(options.pop("types", ()))
    steps = parse_json_path(iterator)
    paths = {name: parse_json_path(name) for name in references}
    dtype = _document_type(steps, paths or {"$": []})
    if isinstance(dtype, T.StringType) or (steps and steps[0] is not None and not isinstance(dtype, T.StructType)):
        frame = spark.read.text(path, wholetext=not lines)
        return expand_json(frame, "value", iterator, references, types)
    if isinstance(dtype, T.ArrayType):
        # Spark's reader streams the elements of a top-level array as rows by itself.
        dtype, steps = dtype.elementType, steps[1:]
        if not isinstance(dtype, T.StructType):
            frame = spark.read.text(path, wholetext=not lines)
            return expand_json(frame, "value", iterator, references, types)
    reader = spark.read.schema(dtype).options(multiLine=not lines, primitivesAsString=True, **{"mode": "FAILFAST", **options})
    frame = reader.json(path)
    frame = frame.select(F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias("_json"))
    return _references(_iterate(frame, "_json", steps), "_json", [], paths, references, types)
