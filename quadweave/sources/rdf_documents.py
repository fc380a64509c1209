"""Load job for document formats that cannot be split: Turtle family, RDF/XML, JSON-LD.

Spark spreads the documents over tasks, one row each; a small generator turns one document into
statement rows in Arrow batches. A document is never collected with others.
"""

from __future__ import annotations

import json
import re
import sys
import xml.etree.ElementTree as ElementTree
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.operators.schema import STATEMENT_COLUMNS
from quadweave.vocab import (
    RDF,
    RDF_FIRST,
    RDF_NIL,
    RDF_REST,
    RDF_TYPE,
    XSD_BOOLEAN,
    XSD_DECIMAL,
    XSD_DOUBLE,
    XSD_INTEGER,
    XSD_STRING,
)

Node = tuple[str, str]  # kind, value
Statement = tuple  # in the order of STATEMENT_COLUMNS
# Workers need no copy of this package on their path: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOCUMENT_SCHEMA = "file string, " + ", ".join(f"{name} string" for name in STATEMENT_COLUMNS)
BATCH = 10_000


def scan_documents(spark: SparkSession, paths: list[str], fmt: str) -> DataFrame:
    documents = (
        spark.read.option("recursiveFileLookup", True)
        .text(paths, wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("file"))
    )
    return parse_documents(documents, fmt)


def parse_documents(documents: DataFrame, fmt: str) -> DataFrame:
    """Statements of a frame with ``value`` (a whole document) and ``file``."""
    parse = PARSERS[fmt]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, text in zip(batch["file"], batch["value"]):
                rows = []
                try:
                    for statement in parse(text, file):
                        rows.append((file, *statement))
                        if len(rows) >= BATCH:
                            yield pd.DataFrame(rows, columns=["file", *STATEMENT_COLUMNS])
                            rows = []
                except (ValueError, KeyError, IndexError, TypeError, SyntaxError) as error:
                    raise ValueError(f"Exception occurred while parsing {file}: {error}") from error
                if rows:
                    yield pd.DataFrame(rows, columns=["file", *STATEMENT_COLUMNS])

    return documents.select("file", "value").mapInPandas(run, DOCUMENT_SCHEMA)


def parse_piece(text: str, file: str, place: str, prefixes: dict[str, str]) -> list[tuple]:
    """Statements of a piece of a Turtle or TriG file, cut between statements."""
    try:
        reader = _TurtleReader(text, file, f"{place}.")
        reader.prefixes = {name[:-1]: reader.resolve(iri) for name, iri in prefixes.items()}
        return [(file, *statement) for statement in reader.statements()]
    except ValueError as error:
        raise ValueError(f"Exception occurred while parsing {file}: {error}") from error


def _row(subject: Node, predicate: str, obj: tuple, graph: str | None) -> Statement:
    kind, value, datatype, language = (*obj, None, None)[:4]
    if language:
        datatype, language = None, language.lower()
    return (*subject, predicate, kind, value, None if datatype == XSD_STRING else datatype, language, graph)


# --- Turtle, TriG and the N3 subset they share -------------------------------------------------

_TOKEN = re.compile(
    r"""(?:\s+|\#[^\n]*+)*+(?:
    (?P<iri><(?!<)[^<>"{}|^`\x00-\x20]*>)
    |(?P<long>\"{3}(?:\"{0,2}(?:[^"\\]|\\.))*\"{3}|'{3}(?:'{0,2}(?:[^'\\]|\\.))*'{3})
    |(?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<directive>@prefix\b|@base\b|(?:PREFIX|BASE|GRAPH)\b(?!:))
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<bnode>_:\w(?:[\w.-]*[\w-])?)
    |(?P<name>(?:\w(?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?\#@%])
        (?:(?:[\w.:-]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?\#@%])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>a\b|true\b|false\b)
    |(?P<mark>\^\^|[.;,\[\](){}=])
    )""",
    re.X | re.S | re.I,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _unescape(text: str) -> str:
    def replaced(match: re.Match) -> str:
        code = match.group(1)
        return chr(int(code[1:], 16)) if len(code) > 1 else _ESCAPES.get(code, code)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", replaced, text, flags=re.S) if "\\" in text else text


class _TurtleReader:
    """Recursive reader over one document; ``emit`` collects what the current statement produced."""

    def __init__(self, text: str, base: str, place: str = "") -> None:
        self.text, self.position, self.base, self.place = text, 0, base, place
        self.prefixes: dict[str, str] = {}
        self.graph: str | None = None
        self.counter = 0
        self.rows: list[Statement] = []
        self.kind: str | None = None
        self.value = ""
        self.advance()

    def advance(self) -> None:
        match = _TOKEN.match(self.text, self.position)
        if match:
            self.kind, self.value, self.position = match.lastgroup, match.group(match.lastgroup), match.end()
        elif re.fullmatch(r"(?:\s+|#[^\n]*)*", self.text[self.position :]):
            self.kind, self.value = None, ""
        else:
            line = self.text.count("\n", 0, self.position) + 1
            raise ValueError(f"unexpected text near line {line}: {self.text[self.position : self.position + 40]!r}")

    def accept(self, mark: str) -> bool:
        if self.kind == "mark" and self.value == mark:
            self.advance()
            return True
        return False

    def expect(self, mark: str) -> None:
        if not self.accept(mark):
            line = self.text.count("\n", 0, self.position) + 1
            raise ValueError(f"expected '{mark}' but found {self.value!r} near line {line}")

    def resolve(self, iri: str) -> str:
        iri = _unescape(iri)
        if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri):
            return iri
        return self.base.partition("#")[0] + iri if iri.startswith("#") or not iri else _join(self.base, iri)

    def fresh(self) -> Node:
        self.counter += 1
        return "bnode", f"[{self.place}{self.counter}]"

    def statements(self) -> Iterator[Statement]:
        while self.kind is not None:
            self.statement()
            yield from self.rows
            self.rows.clear()

    def statement(self) -> None:
        if self.kind == "directive" and self.value.lower() != "graph":
            self.directive()
            return
        if self.kind == "directive":
            self.advance()
            self.graph_block(self.resource())
        elif self.kind == "mark" and self.value == "{":
            self.graph_block(None)
        else:
            bare = self.kind == "mark" and self.value == "["
            subject = self.resource()
            if self.kind == "mark" and self.value == "{":
                self.graph_block(subject)
                return
            if not (bare and self.kind == "mark" and self.value in ".}"):
                self.predicates(subject)
            if not (self.graph_open and self.kind == "mark" and self.value == "}"):
                self.expect(".")

    graph_open = False

    def graph_block(self, name: Node | None) -> None:
        self.expect("{")
        self.graph = None if name is None else name[1] if name[0] == "iri" else "_:" + name[1]
        self.graph_open = True
        while not self.accept("}"):
            if self.kind is None:
                raise ValueError("graph block without an end")
            self.statement()
        self.graph, self.graph_open = None, False
        self.accept(".")

    def directive(self) -> None:
        word = self.value.lower().lstrip("@")
        dotted = self.value.startswith("@")
        self.advance()
        if word == "prefix":
            name = self.value
            if self.kind != "name" or not name.endswith(":"):
                raise ValueError(f"bad prefix name {name!r}")
            self.advance()
            self.prefixes[name[:-1]] = self.resolve(self.value[1:-1])
        else:
            self.base = self.resolve(self.value[1:-1])
        if self.kind != "iri":
            raise ValueError(f"expected an IRI but found {self.value!r}")
        self.advance()
        if dotted:
            self.expect(".")

    def predicates(self, subject: Node) -> None:
        while True:
            if self.kind == "word" and self.value == "a":
                self.advance()
                predicate: Node = ("iri", RDF_TYPE)
            else:
                predicate = self.resource()
            if predicate[0] != "iri":
                raise ValueError("a predicate has to be an IRI")
            while True:
                self.rows.append(_row(subject, predicate[1], self.object(), self.graph))
                if not self.accept(","):
                    break
            repeated = False
            while self.accept(";"):
                repeated = True
            if not repeated or self.kind is None or (self.kind == "mark" and self.value in ".]}"):
                return

    def resource(self) -> Node:
        kind, value = self.kind, self.value
        if kind == "iri":
            self.advance()
            return "iri", self.resolve(value[1:-1])
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"undeclared prefix '{prefix}'")
            self.advance()
            return "iri", self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        if kind == "bnode":
            self.advance()
            return "bnode", value[2:]
        if self.accept("["):
            node = self.fresh()
            if not self.accept("]"):
                self.predicates(node)
                self.expect("]")
            return node
        if self.accept("("):
            return self.collection()
        raise ValueError(f"expected a resource but found {value!r}")

    def collection(self) -> Node:
        head = previous = None
        while not self.accept(")"):
            item, node = self.object(), self.fresh()
            if previous is None:
                head = node
            else:
                self.rows.append(_row(previous, RDF_REST, node, self.graph))
            self.rows.append(_row(node, RDF_FIRST, item, self.graph))
            previous = node
        if previous is None:
            return "iri", RDF_NIL
        self.rows.append(_row(previous, RDF_REST, ("iri", RDF_NIL), self.graph))
        return head

    def object(self) -> tuple:
        kind, value = self.kind, self.value
        if kind in ("string", "long"):
            self.advance()
            text = _unescape(value[3:-3] if kind == "long" else value[1:-1])
            if self.kind == "lang":
                language = self.value[1:]
                self.advance()
                return "literal", text, None, language
            if self.accept("^^"):
                return "literal", text, self.resource()[1]
            return "literal", text
        if kind == "number":
            self.advance()
            exponent, point = "e" in value.lower(), "." in value
            return "literal", value, XSD_DOUBLE if exponent else XSD_DECIMAL if point else XSD_INTEGER
        if kind == "word" and value in ("true", "false"):
            self.advance()
            return "literal", value, XSD_BOOLEAN
        return self.resource()


def _join(base: str, reference: str) -> str:
    from urllib.parse import urljoin

    return urljoin(base, reference) or base + reference


def _parse_turtle(text: str, file: str) -> Iterator[Statement]:
    return _TurtleReader(text, file).statements()


# --- RDF/XML -----------------------------------------------------------------------------------

_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = "{" + RDF + "}"


def _parse_rdf_xml(text: str, file: str) -> Iterator[Statement]:
    rows: list[Statement] = []
    counter = 0

    def iri(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def fresh() -> Node:
        nonlocal counter
        counter += 1
        return "bnode", f"[{counter}]"

    def node(element, base: str, language: str | None) -> Node:
        base = element.get(_XML + "base", base)
        language = element.get(_XML + "lang", language)
        about, name, label = (element.get(_R + key) for key in ("about", "ID", "nodeID"))
        if about is not None:
            subject: Node = ("iri", _join(base, about) if about else base)
        elif name is not None:
            subject = ("iri", base.partition("#")[0] + "#" + name)
        else:
            subject = ("bnode", label) if label else fresh()
        if element.tag != _R + "Description":
            rows.append(_row(subject, RDF_TYPE, ("iri", iri(element.tag)), None))
        attributes(element, subject, base, language)
        position = 0
        for child in element:
            position += child.tag == _R + "li"
            predicate = f"{RDF}_{position}" if child.tag == _R + "li" else iri(child.tag)
            prop(child, subject, predicate, child.get(_XML + "base", base), child.get(_XML + "lang", language))
        return subject

    def attributes(element, subject: Node, base: str, language: str | None) -> None:
        for key, value in element.attrib.items():
            if key == _R + "type":
                rows.append(_row(subject, RDF_TYPE, ("iri", _join(base, value)), None))
            elif not key.startswith((_R, _XML)):
                rows.append(_row(subject, iri(key), ("literal", value, None, language), None))

    def prop(element, subject: Node, predicate: str, base: str, language: str | None) -> None:
        resource, label = element.get(_R + "resource"), element.get(_R + "nodeID")
        mode, datatype = element.get(_R + "parseType"), element.get(_R + "datatype")
        if mode == "Resource":
            target = fresh()
            for child in element:
                prop(child, target, iri(child.tag), base, child.get(_XML + "lang", language))
        elif mode == "Collection":
            target = ("iri", RDF_NIL)
            for child in reversed(list(element)):
                cell = fresh()
                rows.append(_row(cell, RDF_FIRST, node(child, base, language), None))
                rows.append(_row(cell, RDF_REST, target, None))
                target = cell
        elif mode == "Literal":
            inner = (element.text or "") + "".join(ElementTree.tostring(c, "unicode") for c in element)
            target = ("literal", inner, RDF + "XMLLiteral")
        elif resource is not None:
            target = ("iri", _join(base, resource) if resource else base)
            attributes(element, target, base, language)
        elif label is not None:
            target = ("bnode", label)
        elif len(element):
            target = node(element[0], base, language)
        elif any(not key.startswith((_R, _XML)) for key in element.attrib):
            target = fresh()
            attributes(element, target, base, language)
        else:
            target = ("literal", element.text or "", datatype, None if datatype else language)
        rows.append(_row(subject, predicate, target, None))

    root = ElementTree.fromstring(text.encode("utf-8"))
    tops = list(root) if root.tag == _R + "RDF" else [root]
    base, language = root.get(_XML + "base", file), root.get(_XML + "lang")
    for top in tops:
        node(top, base, language)
        yield from rows
        rows.clear()


# --- JSON-LD with inline contexts --------------------------------------------------------------


def _parse_json_ld(text: str, file: str) -> Iterator[Statement]:
    rows: list[Statement] = []
    counter = 0

    def merged(context: dict, local) -> dict:
        for item in local if isinstance(local, list) else [local]:
            if isinstance(item, str):
                raise ValueError(f"remote context {item!r} is not supported")
            context = {**context, **(item or {})}
        return context

    def expand(term: str, context: dict, *, vocab: bool) -> str:
        definition = context.get(term) if vocab else None
        if isinstance(definition, dict):
            definition = definition.get("@id", None)
        if definition and definition != term:
            return expand(definition, context, vocab=True)
        prefix, colon, local = term.partition(":")
        if colon and not local.startswith("//") and prefix in context and prefix != "_":
            inner = context[prefix]
            return expand(inner["@id"] if isinstance(inner, dict) else inner, context, vocab=True) + local
        if colon or term.startswith("@"):
            return term
        return context.get("@vocab", "") + term if vocab else _join(context.get("@base", file), term)

    def resource(name: str) -> Node:
        return ("bnode", name[2:]) if name.startswith("_:") else ("iri", name)

    def value(item, context: dict, definition: dict, graph: str | None) -> tuple | None:
        if isinstance(item, dict):
            if "@value" in item:
                datatype = item.get("@type") and expand(item["@type"], context, vocab=True)
                return scalar(item["@value"], datatype, item.get("@language"))
            if "@list" in item:
                return listed(item["@list"], context, definition, graph)
            if "@set" in item:
                raise ValueError("a nested @set is not supported")
            return node(item, context, graph)
        kind = definition.get("@type")
        if isinstance(item, str) and kind in ("@id", "@vocab"):
            return resource(expand(item, context, vocab=kind == "@vocab"))
        datatype = kind and expand(kind, context, vocab=True)
        language = definition.get("@language", context.get("@language"))
        return scalar(item, datatype, language if isinstance(item, str) and not datatype else None)

    def scalar(item, datatype: str | None, language: str | None) -> tuple:
        if isinstance(item, bool):
            return "literal", str(item).lower(), datatype or XSD_BOOLEAN
        if isinstance(item, int):
            return "literal", str(item), datatype or XSD_INTEGER
        if isinstance(item, float):
            mantissa, _, exponent = f"{item:.15E}".partition("E")
            digits = mantissa.rstrip("0")
            return "literal", f"{digits + '0' if digits.endswith('.') else digits}E{int(exponent)}", datatype or XSD_DOUBLE
        return "literal", item, datatype, language

    def listed(items, context: dict, definition: dict, graph: str | None) -> Node:
        nonlocal counter
        target: Node = ("iri", RDF_NIL)
        for item in reversed(items if isinstance(items, list) else [items]):
            counter += 1
            cell: Node = ("bnode", f"[{counter}]")
            rows.append(_row(cell, RDF_FIRST, value(item, context, definition, graph), graph))
            rows.append(_row(cell, RDF_REST, target, graph))
            target = cell
        return target

    def node(item: dict, context: dict, graph: str | None) -> Node:
        nonlocal counter
        if "@context" in item:
            context = merged(context, item["@context"])
        names = {expand(key, context, vocab=True): key for key in item if key != "@context"}
        if "@id" in names:
            subject = resource(expand(item[names["@id"]], context, vocab=False))
        else:
            counter += 1
            subject = ("bnode", f"[{counter}]")
        for predicate, key in names.items():
            content = item[key]
            if content is None:
                continue
            values = content if isinstance(content, list) else [content]
            definition = context.get(key) if isinstance(context.get(key), dict) else {}
            if predicate == "@graph":
                is_named = "@id" in names or len(names) > 1
                label = subject[1] if subject[0] == "iri" else "_:" + subject[1]
                for inner in values:
                    node(inner, context, label if is_named else graph)
            elif predicate == "@type":
                for kind in values:
                    rows.append(_row(subject, RDF_TYPE, resource(expand(kind, context, vocab=True)), graph))
            elif predicate.startswith("@") or ":" not in predicate:
                continue  # other keywords, and keys no context maps to an IRI
            elif definition.get("@container") == "@list":
                rows.append(_row(subject, predicate, listed(values, context, definition, graph), graph))
            else:
                if isinstance(content, dict) and "@set" in content:
                    values = content["@set"]
                for entry in values:
                    if entry is not None:
                        rows.append(_row(subject, predicate, value(entry, context, definition, graph), graph))
        return subject

    document = json.loads(text)
    if not isinstance(document, (dict, list)):
        raise ValueError("a JSON-LD document is an object or an array")
    for top in document if isinstance(document, list) else [document]:
        node(top, {}, None)
        yield from rows
        rows.clear()


PARSERS: dict[str, Callable[[str, str], Iterator[Statement]]] = {
    **dict.fromkeys(("ttl", "ttls", "trig", "trigs", "n3"), _parse_turtle),
    "rdf": _parse_rdf_xml,
    "jsonld": _parse_json_ld,
}
