"""XML sources. The read schema is derived from the iterator and references of the mapping.

Supported paths: child steps, a final ``@attribute`` or ``text()``, and ``.``; an iterator is
``/root/.../element`` or ``//element``. An element step may match many nodes, so it is read as an
array and its values are multi-valued; values are always text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadweave.errors import SourceError

_NAME = re.compile(r"^@?[^\W\d][\w.:-]*$")
TEXT = "_VALUE"


def parse_reference(path: str) -> tuple[list[str], str | None]:
    """Element steps and the final attribute or text field, if the path ends in one."""
    steps = [step for step in path.strip().split("/") if step not in ("", ".")]
    if path.strip().startswith("/") or "//" in path:
        raise SourceError(f"unsupported XPath reference '{path}': it has to be child steps from the iterator")
    last = None
    if steps and steps[-1] == "text()":
        last, steps = TEXT, steps[:-1]
    elif steps and steps[-1].startswith("@"):
        last, steps = "_" + steps[-1][1:], steps[:-1]
    if not steps and last is None:
        last = TEXT
    if any(not _NAME.match(step) or step.startswith("@") for step in steps) or (
        last and last != TEXT and not _NAME.match(last[1:])
    ):
        raise SourceError(f"unsupported XPath reference '{path}': use child steps, @attribute, text() and .")
    return steps, last


def parse_iterator(path: str | None) -> tuple[list[str], bool]:
    """Element names of the iterator and whether it matches at any depth."""
    anywhere = bool(path) and path.startswith("//")
    if path and "//" in path[1:]:
        raise SourceError(f"unsupported XPath iterator '{path}': // may only come first")
    steps = [step for step in (path or "").split("/") if step]
    if not steps or not path.startswith("/") or any(not _NAME.match(s) or s.startswith("@") for s in steps):
        raise SourceError(f"unsupported XPath iterator '{path}': use /root/element or //element")
    if anywhere and len(steps) > 1:
        raise SourceError(f"unsupported XPath iterator '{path}': // takes a single element name")
    return steps, anywhere


class _Element:
    def __init__(self) -> None:
        self.children: dict[str, _Element] = {}
        self.fields: set[str] = set()

    def add(self, steps: Sequence[str], last: str | None) -> None:
        if steps:
            self.children.setdefault(steps[0], _Element()).add(steps[1:], last)
        else:
            self.fields.add(last or TEXT)

    def dtype(self) -> T.StructType:
        fields = [T.StructField(name, T.ArrayType(node.dtype())) for name, node in self.children.items()]
        fields += [T.StructField(name, T.StringType()) for name in sorted(self.fields)]
        return T.StructType(fields)


def _element_for(references: Sequence[str]) -> _Element:
    root = _Element()
    for name in references:
        root.add(*parse_reference(name))
    if not root.children and not root.fields:
        root.fields.add(TEXT)
    return root


def _values(row: Column, steps: Sequence[str], last: str | None) -> Column:
    if not steps:
        return row.getField(last or TEXT)
    children = row.getField(steps[0])
    rest = steps[1:]
    nested = F.transform(children, lambda child: _values(child, rest, last))
    nested = F.flatten(nested) if rest else nested
    return F.filter(nested, lambda value: value.isNotNull()) if len(steps) == 1 else nested


def _references(rows: DataFrame, value: str, references: Sequence[str]) -> DataFrame:
    return rows.select(*[_values(F.col(value), *parse_reference(name)).alias(name) for name in references])


def _nested(schema: T.StructType, steps: Sequence[str]) -> T.StructType:
    for name in reversed(steps):
        schema = T.StructType([T.StructField(name, T.ArrayType(schema))])
    return schema


def _iterate(frame: DataFrame, value: str, steps: Sequence[str]) -> DataFrame:
    for name in steps:
        frame = frame.select(F.explode(F.col(value).getField(name)).alias(value))
    return frame


def read_xml(
    spark: SparkSession, path: str, iterator: str | None, references: Sequence[str], options: dict[str, object]
) -> DataFrame:
    """One row per iterator match. A malformed document is an error, unless the option ``mode`` says otherwise.

    ``/a/b/c`` reads a document from its root, because an element name alone does not tell its
    place. ``unique_tag=True`` promises that the last name occurs nowhere else, and ``//c`` does not
    care: both stream element by element, whatever the size of a document.
    """
    unique_tag = bool(options.pop("unique_tag", False))
    steps, anywhere = parse_iterator(iterator)
    element = _element_for(references).dtype()
    if anywhere or unique_tag or len(steps) == 1:
        row_tag, inside = steps[-1], []
    else:
        row_tag, inside = steps[0], steps[1:]
    frame = (
        spark.read.format("xml")
        .options(**{"rowTag": row_tag, "inferSchema": False, "mode": "FAILFAST", **options})
        .schema(_nested(element, inside))
        .load(path)
    )
    frame = frame.select(F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias("_xml"))
    return _references(_iterate(frame, "_xml", inside), "_xml", references)


def expand_xml(frame: DataFrame, column: str, iterator: str | None, references: Sequence[str]) -> DataFrame:
    """Iterate a column that holds one XML document per row."""
    steps, anywhere = parse_iterator(iterator)
    if anywhere:
        raise SourceError("an iterator over a column of documents has to start at the root element")
    schema = _nested(_element_for(references).dtype(), steps[1:])
    frame = frame.select(F.explode(F.array(F.from_xml(F.col(f"`{column}`"), schema, {"mode": "FAILFAST"}))).alias("_xml"))
    return _references(_iterate(frame, "_xml", steps[1:]), "_xml", references)
