"""Statements as RDF text: every format is a column of text rows that Spark's text writer stores.

Row formats are map-only. Grouped formats shuffle once by subject. Each part file is a document of
its own: a first row carries the header, and formats with an enclosing element get their frame in a
pass over Arrow batches that does not look at the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quadweave.operators import bnodes, rendering
from quadweave.operators.grouping import (
    MAX_GROUP,
    predicate_lists,
    subject_groups,
    trig_blocks,
    turtle_blocks,
)
from quadweave.operators.rendering import escape_xml
from quadweave.plans.output import output_format, plan_output
from quadweave.sources.files import output_location
from quadweave.vocab import RDF, RDF_TYPE

Watch = Callable[[DataFrame], DataFrame] | None


@dataclass(frozen=True)
class WriteReport:
    """What a write produced. ``written_distinct`` is known where the sink builds a set."""

    path: str
    written_raw: int
    written_distinct: int | None


def render_rdf(
    statements: DataFrame,
    fmt: str = "nq",
    *,
    prefixes: Mapping[str, str] | None = None,
    pretty: bool = False,
    inline_bnodes: bool = False,
    max_group: int | None = MAX_GROUP,
) -> DataFrame:
    """The text rows of a format as a column ``value``, with each partition a complete document."""
    return _render(statements, fmt, prefixes, pretty, inline_bnodes, max_group, None, None)


def write_rdf(
    statements: DataFrame,
    path: str,
    fmt: str = "nq",
    *,
    prefixes: Mapping[str, str] | None = None,
    pretty: bool = False,
    relabel: bool = False,
    inline_bnodes: bool = False,
    max_group: int | None = MAX_GROUP,
    compression: str | None = None,
) -> WriteReport:
    """Write statements below ``path``, replacing an earlier output; counts come from the same pass."""
    location = output_location(statements.sparkSession, path)
    if relabel:
        statements = bnodes.relabel(statements)
    return write_at(
        statements, location, fmt,
        prefixes=prefixes, pretty=pretty, inline_bnodes=inline_bnodes, max_group=max_group, compression=compression,
    )


def write_at(
    statements: DataFrame,
    location: str,
    fmt: str,
    *,
    prefixes: Mapping[str, str] | None = None,
    pretty: bool = False,
    inline_bnodes: bool = False,
    max_group: int | None = MAX_GROUP,
    compression: str | None = None,
) -> WriteReport:
    """Write statements to exactly that folder, whatever it holds."""
    plan = plan_output(fmt, pretty)
    raw, distinct = Observation(), Observation()
    if inline_bnodes and pretty and plan.format in ("ttl", "ttls", "n3"):
        # Inlining merges statements into blocks, so only what goes in can be counted on the way.
        counted = statements.agg(F.count(F.lit(1)).alias("n")).first()["n"]
        text = _render(statements, fmt, prefixes, True, True, max_group, None, None)
        _write_text(text, location, compression)
        return WriteReport(location, counted, None)

    def watch_raw(frame: DataFrame) -> DataFrame:
        return frame.observe(raw, F.count(F.lit(1)).alias("n"))

    def watch_groups(frame: DataFrame) -> DataFrame:
        return frame.observe(distinct, F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    text = _render(statements, fmt, prefixes, pretty, False, max_group, watch_raw, watch_groups)
    _write_text(text, location, compression)
    return WriteReport(location, _counted(raw, statements), _counted(distinct, statements) if plan.grouped else None)


def _counted(observation: Observation, statements: DataFrame) -> int:
    """An observed count. Spark drops the observing node where it finds its input empty: no metric then means zero."""
    try:
        return observation.get["n"]
    except Py4JJavaError:
        if statements.isEmpty():
            return 0
        raise


def _write_text(text: DataFrame, location: str, compression: str | None) -> None:
    writer = text.write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).text(location)


def write_per_graph(
    statements: DataFrame, path: str, fmt: str = "nt", *, compression: str | None = None
) -> str:
    """One directory per graph for formats that cannot name graphs; the default graph is the NULL one.

    Graphs are rebalanced first: a large graph is split over several files, small ones do not leave
    a file per task behind.
    """
    if output_format(fmt) not in ("nt", "ttl", "n3", "ttls"):
        raise ValueError(f"'{fmt}' is no line format without graphs")
    location = output_location(statements.sparkSession, path)
    line = rendering.ntriples_line() if output_format(fmt) == "nt" else rendering.turtle_line()
    text = statements.select("g", line.alias("value")).hint("rebalance", F.col("g"))
    writer = text.write.mode("overwrite").partitionBy("g")
    (writer.option("compression", compression) if compression else writer).text(location)
    return location


def _render(
    statements: DataFrame,
    fmt: str,
    prefixes: Mapping[str, str] | None,
    pretty: bool,
    inline_bnodes: bool,
    max_group: int | None,
    watch: Watch,
    watch_groups: Watch,
) -> DataFrame:
    plan = plan_output(fmt, pretty)
    name = plan.format
    if not plan.grouped:
        if watch:
            statements = watch(statements)
        return _render_rows(statements, name, prefixes)
    if name in ("ttl", "ttls", "n3", "rdf", "rj"):
        statements = statements.withColumn("g", F.lit(None).cast("string"))
    if name in ("ttl", "ttls", "n3"):
        if inline_bnodes:
            blocks = bnodes.inlined_blocks(statements, prefixes, max_group)
        else:
            blocks = turtle_blocks(statements, prefixes, max_group, watch)
        blocks = watch_groups(blocks) if watch_groups else blocks
        return _with_header(blocks.select(F.col("block").alias("value")), rendering.prefix_header(prefixes))
    if name in ("trig", "trigs"):
        blocks = trig_blocks(statements, prefixes, max_group, watch)
        blocks = watch_groups(blocks) if watch_groups else blocks
        return _with_header(blocks.select(F.col("block").alias("value")), rendering.prefix_header(prefixes))
    renderer = {
        "trix": trix_groups,
        "rdf": rdf_xml_blocks,
        "jsonld": json_ld_nodes,
        "ndjsonld": json_ld_nodes,
        "rj": rdf_json_objects,
    }[name]
    blocks = renderer(statements, max_group, watch)
    blocks = watch_groups(blocks) if watch_groups else blocks
    text = blocks.select(F.col("block").alias("value"))
    if name == "jsonld":
        first = _is_first_row()
        text = text.select(F.when(first, F.col("value")).otherwise(F.concat(F.lit(","), F.col("value"))).alias("value"))
    return _framed(text, *FRAMES[name]) if name in FRAMES else text


def _render_rows(statements: DataFrame, name: str, prefixes: Mapping[str, str] | None) -> DataFrame:
    if name == "nt":
        return statements.select(rendering.ntriples_line().alias("value"))
    if name == "nq":
        return statements.select(rendering.nquads_line().alias("value"))
    if name == "trix":
        return _framed(statements.select(trix_statement().alias("value")), *FRAMES["trix"])
    line = rendering.trig_line(prefixes) if name in ("trig", "trigs") else rendering.turtle_line(prefixes)
    return _with_header(statements.select(line.alias("value")), rendering.prefix_header(prefixes))


# --- headers and frames ------------------------------------------------------------------------


def _is_first_row() -> Column:
    """Whether a row is the first of its partition: the low bits of the generated id count rows."""
    return F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0


def _with_header(text: DataFrame, header: str) -> DataFrame:
    if not header:
        return text
    led = F.concat(F.lit(header + "\n"), F.col("value"))
    return text.select(F.when(_is_first_row(), led).otherwise(F.col("value")).alias("value"))


# The enclosing lines of document formats.
FRAMES = {
    "trix": (
        '<?xml version="1.0" encoding="UTF-8"?>\n<TriX xmlns="http://www.w3.org/2004/03/trix/trix-1/">',
        "</TriX>",
    ),
    "rdf": (f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="{RDF}">', "</rdf:RDF>"),
    "jsonld": ("[", "]"),
}


def _framed(text: DataFrame, opening: str, closing: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(values: pa.Array) -> pa.RecordBatch:
            # All batches of a stream need one schema, whatever the input says about NULLs.
            return pa.RecordBatch.from_arrays([values.cast(pa.string())], ["value"])

        yield rows(pa.array([opening]))
        for batch in batches:
            yield rows(batch.column(0))
        yield rows(pa.array([closing]))

    return text.mapInArrow(run, "value string")


# --- XML formats -------------------------------------------------------------------------------


def _element(tag: str, content: Column, attributes: Column | None = None) -> Column:
    opening = F.lit(f"<{tag}>") if attributes is None else F.concat(F.lit(f"<{tag} "), attributes, F.lit(">"))
    return F.concat(opening, content, F.lit(f"</{tag}>"))


def _trix_resource(kind: Column, value: Column) -> Column:
    return F.when(kind == "bnode", _element("id", value)).otherwise(_element("uri", escape_xml(value)))


def trix_triple() -> Column:
    lexical = escape_xml(F.col("o"))
    language = F.concat(F.lit('xml:lang="'), F.col("o_lang"), F.lit('"'))
    datatype = F.concat(F.lit('datatype="'), escape_xml(F.col("o_dt")), F.lit('"'))
    literal = (
        F.when(F.col("o_lang").isNotNull(), _element("plainLiteral", lexical, language))
        .when(F.col("o_dt").isNotNull(), _element("typedLiteral", lexical, datatype))
        .otherwise(_element("plainLiteral", lexical))
    )
    obj = F.when(F.col("o_kind") == "literal", literal).otherwise(_trix_resource(F.col("o_kind"), F.col("o")))
    subject = _trix_resource(F.col("s_kind"), F.col("s"))
    return _element("triple", F.concat(subject, _element("uri", escape_xml(F.col("p"))), obj))


def _trix_graph(content: Column) -> Column:
    is_iri = F.col("g").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    name = F.when(is_iri, _element("uri", escape_xml(F.col("g")))).otherwise(_element("id", F.col("g")))
    return _element("graph", F.concat(F.coalesce(name, F.lit("")), content))


def trix_statement() -> Column:
    """A statement as a graph element of its own, which needs no neighbours."""
    return _trix_graph(trix_triple())


def trix_groups(statements: DataFrame, max_group: int | None = MAX_GROUP, watch: Watch = None) -> DataFrame:
    groups = subject_groups(statements, trix_triple(), max_group, watch)
    return groups.select(
        "g", "s", F.size("entries").alias("n"), _trix_graph(F.array_join("entries", "")).alias("block")
    )


def rdf_xml_blocks(statements: DataFrame, max_group: int | None = MAX_GROUP, watch: Watch = None) -> DataFrame:
    """``rdf:Description`` elements. A predicate is cut after its last ``/`` or ``#``, and the rest has
    to be an XML name; blank-node labels get a letter in front, because names cannot start with a digit."""
    name = r"^(.*[/#])([A-Za-z_][A-Za-z0-9._-]*)$"
    local = F.regexp_extract("p", name, 2)
    message = F.concat(F.lit("no XML name can be made from predicate "), F.col("p"))
    tag = F.when(F.col("p").rlike(name), F.concat(F.lit("p:"), local)).otherwise(F.raise_error(message).cast("string"))
    declared = F.concat(F.lit(' xmlns:p="'), escape_xml(F.regexp_extract("p", name, 1)), F.lit('"'))
    is_literal = F.col("o_kind") == "literal"
    attribute = (
        F.when(F.col("o_kind") == "iri", F.concat(F.lit(' rdf:resource="'), escape_xml(F.col("o")), F.lit('"')))
        .when(F.col("o_kind") == "bnode", F.concat(F.lit(' rdf:nodeID="b'), F.col("o"), F.lit('"')))
        .when(F.col("o_lang").isNotNull(), F.concat(F.lit(' xml:lang="'), F.col("o_lang"), F.lit('"')))
        .when(F.col("o_dt").isNotNull(), F.concat(F.lit(' rdf:datatype="'), escape_xml(F.col("o_dt")), F.lit('"')))
        .otherwise("")
    )
    content = F.when(is_literal, escape_xml(F.col("o"))).otherwise("")
    element = F.concat(F.lit("<"), tag, declared, attribute, F.lit(">"), content, F.lit("</"), tag, F.lit(">"))
    groups = subject_groups(statements, element, max_group, watch)
    about = F.when(F.col("s_kind") == "bnode", F.concat(F.lit('rdf:nodeID="b'), F.col("s"))).otherwise(
        F.concat(F.lit('rdf:about="'), escape_xml(F.col("s")))
    )
    block = F.concat(
        F.lit("<rdf:Description "), about, F.lit('">'), F.array_join("entries", ""), F.lit("</rdf:Description>")
    )
    return groups.select("g", "s", F.size("entries").alias("n"), block.alias("block"))


# --- JSON formats ------------------------------------------------------------------------------


def _json_string(value: Column) -> Column:
    text = F.to_json(F.array(value))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _node_name(kind: Column, value: Column) -> Column:
    return F.when(kind == "bnode", F.concat(F.lit("_:"), value)).otherwise(value)


def _object_lists(entries: Column) -> Column:
    """``"p":[o,o],"p":[o]`` from sorted entries of JSON texts."""
    text = predicate_lists(entries, "p", "o", next_predicate="],", next_object=",")
    return F.concat(text, F.lit("]"))


def json_ld_nodes(statements: DataFrame, max_group: int | None = MAX_GROUP, watch: Watch = None) -> DataFrame:
    """Node objects in expanded form; a node of a named graph is wrapped in it."""
    name = _node_name(F.col("o_kind"), F.col("o"))
    is_type = (F.col("p") == RDF_TYPE) & (F.col("o_kind") != "literal")
    value = F.when(
        F.col("o_kind") == "literal",
        F.to_json(
            F.struct(
                F.col("o_lang").alias("@language"), F.col("o_dt").alias("@type"), F.col("o").alias("@value")
            )
        ),
    ).otherwise(F.to_json(F.struct(name.alias("@id"))))
    key = F.when(is_type, '"@type"').otherwise(_json_string(F.col("p")))
    entry = F.struct(
        F.concat(key, F.lit(":[")).alias("p"), F.when(is_type, _json_string(name)).otherwise(value).alias("o")
    )
    groups = subject_groups(statements, entry, max_group, watch)
    subject = _json_string(_node_name(F.col("s_kind"), F.col("s")))
    node = F.concat(F.lit('{"@id":'), subject, F.lit(","), _object_lists(F.col("entries")), F.lit("}"))
    is_iri = F.col("g").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    graph = _json_string(F.when(is_iri, F.col("g")).otherwise(F.concat(F.lit("_:"), F.col("g"))))
    named = F.concat(F.lit('{"@id":'), graph, F.lit(',"@graph":['), node, F.lit("]}"))
    block = F.when(F.col("g").isNull(), node).otherwise(named)
    return groups.select("g", "s", F.size("entries").alias("n"), block.alias("block"))


def rdf_json_objects(statements: DataFrame, max_group: int | None = MAX_GROUP, watch: Watch = None) -> DataFrame:
    """RDF/JSON, one object with one subject per row; the format has no graphs."""
    is_literal = F.col("o_kind") == "literal"
    value = F.to_json(
        F.struct(
            F.when(is_literal, "literal").when(F.col("o_kind") == "bnode", "bnode").otherwise("uri").alias("type"),
            F.when(is_literal, F.col("o")).otherwise(_node_name(F.col("o_kind"), F.col("o"))).alias("value"),
            F.col("o_lang").alias("lang"),
            F.col("o_dt").alias("datatype"),
        )
    )
    entry = F.struct(F.concat(_json_string(F.col("p")), F.lit(":[")).alias("p"), value.alias("o"))
    groups = subject_groups(statements, entry, max_group, watch)
    subject = _json_string(_node_name(F.col("s_kind"), F.col("s")))
    block = F.concat(F.lit("{"), subject, F.lit(":{"), _object_lists(F.col("entries")), F.lit("}}"))
    return groups.select("g", "s", F.size("entries").alias("n"), block.alias("block"))
