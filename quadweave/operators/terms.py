"""Scalar expressions that make RDF terms from source columns.

Everything here is a composition of built-in functions, so term generation stays in one
whole-stage-codegen span together with the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadweave.errors import IriError, MappingError
from quadweave.functions import FunctionRegistry
from quadweave.model import BNODE, IRI, LITERAL, TermMap
from quadweave.vocab import (
    XSD_BOOLEAN,
    XSD_DATE,
    XSD_DATETIME,
    XSD_DECIMAL,
    XSD_DOUBLE,
    XSD_HEX_BINARY,
    XSD_INTEGER,
    XSD_STRING,
)

ABSOLUTE_IRI = r"^[A-Za-z][A-Za-z0-9+.-]*:"
VALID_IRI = ABSOLUTE_IRI + r"[^\u0000- <>\"{}|\\^`]*$"
UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"


# --- lexical forms -----------------------------------------------------------------------------


def canonical_double(value: Column) -> Column:
    """Canonical xsd:double form (``12345.67`` -> ``1.234567E4``)."""
    text = F.abs(value).cast("string")
    whole = F.substring_index(text, ".", 1)
    fraction = F.substring_index(text, ".", -1)
    digits = F.regexp_replace(F.concat(whole, fraction), "^0+|0+$", "")
    leading_zeros = F.length(F.regexp_extract(fraction, "^0*", 0))
    exponent = F.when(whole != "0", F.length(whole) - 1).otherwise(-leading_zeros - 1)
    tail = F.substring(digits, 2, 400)
    mantissa = F.concat(F.substring(digits, 1, 1), F.lit("."), F.when(tail == "", "0").otherwise(tail))
    plain = F.concat(mantissa, F.lit("E"), exponent.cast("string"))
    sign = F.when(value < 0, "-").otherwise("")
    return (
        F.when(value.isNull(), F.lit(None))
        .when(F.isnan(value), "NaN")
        .when(value == float("inf"), "INF")
        .when(value == float("-inf"), "-INF")
        .when(value == 0, "0.0E0")
        .when(F.contains(text, F.lit("E")), F.concat(sign, text))
        .otherwise(F.concat(sign, plain))
    )


def lexical(column: Column, dtype: T.DataType) -> Column:
    """The lexical form of a source value, by the natural mapping of its column type."""
    if isinstance(dtype, T.StringType):
        return column
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return canonical_double(column)
    if isinstance(dtype, T.TimestampNTZType):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(dtype, T.TimestampType):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    if isinstance(dtype, T.BinaryType):
        return F.hex(column)
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column)
    return column.cast("string")


def natural_datatype(dtype: T.DataType) -> str | None:
    """The datatype IRI a column type stands for; ``None`` is a plain string."""
    if isinstance(dtype, T.BooleanType):
        return XSD_BOOLEAN
    if isinstance(dtype, T.IntegralType):
        return XSD_INTEGER
    if isinstance(dtype, T.DecimalType):
        return XSD_DECIMAL
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return XSD_DOUBLE
    if isinstance(dtype, T.DateType):
        return XSD_DATE
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return XSD_DATETIME
    if isinstance(dtype, T.BinaryType):
        return XSD_HEX_BINARY
    return None


# --- IRIs --------------------------------------------------------------------------------------


def encode_iri_part(value: Column, style: str = "ascii") -> Column:
    """Percent-encode a value for use inside an IRI template.

    ``ascii`` encodes everything but unreserved ASCII; ``rfc3987`` leaves non-ASCII letters alone.
    Values that need no encoding, by far the most, only pay for one pattern test.
    """
    if style == "ascii":
        encoded = F.url_encode(value)
        for form_encoded, percent_encoded in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            encoded = F.replace(encoded, F.lit(form_encoded), F.lit(percent_encoded))
        return F.when(value.rlike(r"^[A-Za-z0-9._~-]*$"), value).otherwise(encoded)
    if style == "rfc3987":
        encoded = F.replace(value, F.lit("%"), F.lit("%25"))
        for code in range(128):
            if chr(code) not in UNRESERVED + "%":
                encoded = F.replace(encoded, F.lit(chr(code)), F.lit(f"%{code:02X}"))
        return F.when(value.rlike(r"^[A-Za-z0-9._~ -�-]*$"), value).otherwise(encoded)
    raise MappingError(f"unknown IRI encoding '{style}', use 'ascii' or 'rfc3987'")


def resolve_iri(value: Column, base: str) -> Column:
    """Prepend the base IRI unless the value has a scheme."""
    return F.when(value.rlike(ABSOLUTE_IRI), value).otherwise(F.concat(F.lit(base), value))


def is_valid_iri(value: Column) -> Column:
    return value.rlike(VALID_IRI)


def check_iri(text: str) -> str:
    """The IRI itself, or an error; for parameters given on the driver."""
    if not re.match(VALID_IRI, text):
        raise IriError(f"`{text}` is not a valid IRI")
    return text


def bnode_label(value: Column) -> Column:
    """A label that depends on the value alone: equal in every task, attempt and micro-batch."""
    return F.md5(value)


# --- term maps ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Reference:
    """A source column as term maps see it. ``dtype`` is the element type when it holds several values.

    ``source`` is the column name, or the column itself where a single value has been picked.
    """

    source: str | Column
    dtype: T.DataType
    multi: bool = False

    @property
    def column(self) -> Column:
        return F.col(f"`{self.source}`") if isinstance(self.source, str) else self.source

    def text(self) -> Column:
        return lexical(self.column, self.dtype)


@dataclass(frozen=True)
class TermContext:
    base_iri: str
    functions: FunctionRegistry
    iri_safe: str = "ascii"
    natural_types: bool = True


def scope_of(schema: T.StructType) -> dict[str, Reference]:
    """References to all columns of a flat source."""
    found = {}
    for field in schema.fields:
        multi = isinstance(field.dataType, T.ArrayType)
        dtype = field.dataType.elementType if multi else field.dataType
        found[field.name] = Reference(field.name, dtype, multi)
    return found


def look_up(scope: Mapping[str, Reference], name: str) -> Reference:
    try:
        return scope[name]
    except KeyError:
        raise MappingError(f"the source has no reference '{name}'; it has {sorted(scope)}") from None


def term_kind(term: TermMap, position: str) -> str:
    """IRI, blank node or literal, by declaration or by position."""
    if term.term_type:
        kind = term.term_type
    elif position == "object" and (term.kind in ("reference", "function") or term.datatype or term.language):
        kind = LITERAL
    else:
        kind = IRI
    allowed = {"subject": (IRI, BNODE), "predicate": (IRI,), "graph": (IRI, BNODE), "object": (IRI, BNODE, LITERAL)}
    if kind not in allowed[position]:
        raise MappingError(f"a {position} cannot be a {kind}: {term.value}")
    return kind


def term_datatype(term: TermMap, kind: str, scope: Mapping[str, Reference], context: TermContext) -> str | None:
    """Datatype IRI; ``None`` for strings, language-tagged literals and everything that is no literal."""
    if kind != LITERAL or term.language:
        return None
    datatype = term.datatype
    if datatype is None and term.kind == "reference" and context.natural_types:
        datatype = natural_datatype(look_up(scope, term.value).dtype)
    return None if datatype == XSD_STRING else datatype


def term_language(term: TermMap, scope: Mapping[str, Reference], context: TermContext) -> Column | None:
    if term.language is None:
        return None
    return F.lower(raw_value(term.language, LITERAL, scope, context))


def _needs_encoding(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.IntegralType, T.BooleanType, T.DateType))


def scheme_of_template(parts: Sequence[tuple[str, str]]) -> bool | None:
    """Whether a template is absolute (True), relative (False), or only the row can tell (None)."""
    if not parts or parts[0][0] != "text":
        return None
    head = parts[0][1]
    if re.match(ABSOLUTE_IRI, head):
        return True
    return None if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*$", head) else False


def raw_value(term: TermMap, kind: str, scope: Mapping[str, Reference], context: TermContext) -> Column:
    """The text of a term for one choice of its references, before base resolution and labels."""
    if term.kind == "constant":
        return F.lit(term.value)
    if term.kind == "reference":
        return look_up(scope, term.value).text()
    if term.kind == "function":
        function = context.functions.find(term.value)
        arguments = {name: raw_value(arg, LITERAL, scope, context) for name, arg in term.args}
        result = function.apply(**arguments)
        return result.cast("array<string>" if function.multi else "string")
    pieces = []
    for part, text in term.template_parts():
        if part == "text":
            pieces.append(F.lit(text))
            continue
        reference = look_up(scope, text)
        value = reference.text()
        if kind == IRI and _needs_encoding(reference.dtype):
            value = encode_iri_part(value, context.iri_safe)
        pieces.append(value)
    return F.concat(*pieces) if len(pieces) > 1 else pieces[0].cast("string")


def constant_text(term: TermMap, kind: str, context: TermContext) -> str:
    if kind == IRI and not re.match(ABSOLUTE_IRI, term.value):
        return context.base_iri + term.value
    return term.value


def finish_value(term: TermMap, kind: str, value: Column, context: TermContext) -> Column:
    if kind == BNODE:
        return bnode_label(value)
    if kind != IRI:
        return value
    if term.kind == "constant":
        return F.lit(constant_text(term, kind, context))
    if term.kind == "template":
        absolute = scheme_of_template(term.template_parts())
        if absolute is not None:
            return value if absolute else F.concat(F.lit(context.base_iri), value)
    return resolve_iri(value, context.base_iri)


def is_multi(term: TermMap, scope: Mapping[str, Reference], context: TermContext) -> bool:
    if term.kind == "function" and context.functions.find(term.value).multi:
        return True
    return any(look_up(scope, name).multi for name in term.references())


def for_each_value(
    names: Sequence[str], scope: Mapping[str, Reference], body: Callable[[Mapping[str, Reference]], Column]
) -> Column:
    """Evaluate ``body`` once per choice of values of the multi-valued references; an array of results.

    Every reference is chosen once, however often a template repeats it; different references
    give their cross product.
    """
    if not names:
        return F.array(body(scope))
    name, rest = names[0], names[1:]
    reference = look_up(scope, name)

    def inner(value: Column) -> Column:
        chosen = {**scope, name: Reference(value, reference.dtype)}
        return for_each_value(rest, chosen, body) if rest else body(chosen)

    nested = F.transform(reference.column, inner)
    return F.flatten(nested) if rest else nested


def term_value(term: TermMap, position: str, scope: Mapping[str, Reference], context: TermContext) -> Column:
    """A term as a string column, or as an array of strings when :func:`is_multi` holds."""
    kind = term_kind(term, position)
    if not is_multi(term, scope, context):
        return finish_value(term, kind, raw_value(term, kind, scope, context), context)
    names = [name for name in term.references() if look_up(scope, name).multi]
    if term.kind == "function" and context.functions.find(term.value).multi:
        arrays = for_each_value(names, scope, lambda chosen: raw_value(term, kind, chosen, context))
        return F.transform(F.flatten(arrays), lambda value: finish_value(term, kind, value, context))
    return for_each_value(
        names, scope, lambda chosen: finish_value(term, kind, raw_value(term, kind, chosen, context), context)
    )
