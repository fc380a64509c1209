"""Terms and statements as text (N-Triples grammar, and the Turtle shorthand with prefixes)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadweave.operators.prefixes import compact_iri
from quadweave.vocab import RDF_TYPE

# Characters N-Triples literals have to escape.
ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def escape_literal(value: Column) -> Column:
    return reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), ESCAPES, value)


def iri_text(value: Column, prefixes: Mapping[str, str] | None = None) -> Column:
    return compact_iri(value, prefixes) if prefixes else F.concat(F.lit("<"), value, F.lit(">"))


def resource_text(kind: Column, value: Column, prefixes: Mapping[str, str] | None = None) -> Column:
    return F.when(kind == "bnode", F.concat(F.lit("_:"), value)).otherwise(iri_text(value, prefixes))


def subject_text(prefixes: Mapping[str, str] | None = None) -> Column:
    return resource_text(F.col("s_kind"), F.col("s"), prefixes)


def predicate_text(prefixes: Mapping[str, str] | None = None, shorthand: bool = False) -> Column:
    text = iri_text(F.col("p"), prefixes)
    return F.when(F.col("p") == RDF_TYPE, "a").otherwise(text) if shorthand else text


def object_text(prefixes: Mapping[str, str] | None = None) -> Column:
    quoted = F.concat(F.lit('"'), escape_literal(F.col("o")), F.lit('"'))
    literal = (
        F.when(F.col("o_lang").isNotNull(), F.concat(quoted, F.lit("@"), F.col("o_lang")))
        .when(F.col("o_dt").isNotNull(), F.concat(quoted, F.lit("^^"), iri_text(F.col("o_dt"), prefixes)))
        .otherwise(quoted)
    )
    return F.when(F.col("o_kind") == "literal", literal).otherwise(
        resource_text(F.col("o_kind"), F.col("o"), prefixes)
    )


def graph_text(prefixes: Mapping[str, str] | None = None) -> Column:
    """The graph name, NULL for the default graph. A blank graph node has no scheme in its label."""
    name = F.col("g")
    is_iri = name.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    return F.when(is_iri, iri_text(name, prefixes)).otherwise(F.concat(F.lit("_:"), name))


def ntriples_line() -> Column:
    return F.concat(subject_text(), F.lit(" "), predicate_text(), F.lit(" "), object_text(), F.lit(" ."))


def nquads_line() -> Column:
    graph = F.coalesce(F.concat(F.lit(" "), graph_text()), F.lit(""))
    return F.concat(subject_text(), F.lit(" "), predicate_text(), F.lit(" "), object_text(), graph, F.lit(" ."))


def turtle_line(prefixes: Mapping[str, str] | None = None) -> Column:
    return F.concat(
        subject_text(prefixes),
        F.lit(" "),
        predicate_text(prefixes, shorthand=True),
        F.lit(" "),
        object_text(prefixes),
        F.lit(" ."),
    )


def trig_line(prefixes: Mapping[str, str] | None = None) -> Column:
    line = turtle_line(prefixes)
    named = F.concat(graph_text(prefixes), F.lit(" { "), line, F.lit(" }"))
    return F.when(F.col("g").isNull(), line).otherwise(named)


def prefix_header(prefixes: Mapping[str, str] | None) -> str:
    return "\n".join(f"@prefix {name}: <{iri}> ." for name, iri in sorted((prefixes or {}).items()))


def escape_xml(value: Column) -> Column:
    # XML character escapes; a raw carriage return would be normalised away by a reader.
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"))
    return reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), pairs, value)
