"""Mapping documents: from the statements of a mapping to the mapping tree.

The statements may be part of a corpus of any size, so Spark first cuts them down to the mapping
vocabulary; only that small subgraph reaches the driver, and its size is checked.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.errors import MappingError
from quadweave.model import (
    BNODE,
    IRI,
    LITERAL,
    Join,
    Mapping,
    ParentObject,
    PredicateObjectMap,
    Source,
    TermMap,
    TriplesMap,
)
from quadweave.vocab import FNML, FNO, QL, RDF_TYPE, RML, RR

MAX_MAPPING_STATEMENTS = 1_000_000

# The mapping vocabularies' names for term types and reference formulations.
TERM_TYPES = {RR + "IRI": IRI, RR + "BlankNode": BNODE, RR + "Literal": LITERAL}
FORMULATIONS = {QL + "CSV": "csv", QL + "JSONPath": "json", QL + "XPath": "xml"}
SHORTCUTS = {
    "subject": (RR + "subjectMap", RR + "subject"),
    "predicate": (RR + "predicateMap", RR + "predicate"),
    "object": (RR + "objectMap", RR + "object"),
    "graph": (RR + "graphMap", RR + "graph"),
    "language": (RML + "languageMap", RR + "language"),
}


def mapping_from_statements(statements: DataFrame) -> Mapping:
    in_vocabulary = F.col("p") == RDF_TYPE
    for namespace in (RR, RML, FNML, FNO):
        in_vocabulary = in_vocabulary | F.startswith("p", F.lit(namespace))
    candidates = statements.where(in_vocabulary)
    # A type statement only matters on a node that is a source, so data about instances stays out.
    sources = statements.where(F.col("p") == RML + "source").select(F.col("o").alias("s")).distinct()
    vocabulary = candidates.where(F.col("p") != RDF_TYPE).unionByName(
        candidates.where(F.col("p") == RDF_TYPE).join(sources, "s", "left_semi").select(*candidates.columns)
    )
    stream_names = (
        statements.where(F.col("p").rlike(r"[#/]streamName$"))
        .join(sources, "s", "left_semi")
        .select(*candidates.columns)
    )
    rows = vocabulary.unionByName(stream_names).dropDuplicates().limit(MAX_MAPPING_STATEMENTS + 1).collect()
    if len(rows) > MAX_MAPPING_STATEMENTS:
        raise MappingError(f"a mapping of more than {MAX_MAPPING_STATEMENTS} statements is not supported")
    return _Builder(rows).mapping()


class _Builder:
    def __init__(self, rows) -> None:
        self.values: dict[str, dict[str, list]] = defaultdict(lambda: defaultdict(list))
        for row in sorted(rows, key=lambda r: (r.s, r.p, r.o)):
            self.values[row.s][row.p].append(row)

    def all(self, node: str, predicate: str) -> list:
        return self.values[node][predicate] if node in self.values else []

    def one(self, node: str, predicate: str):
        found = self.all(node, predicate)
        if len(found) > 1:
            raise MappingError(f"'{node}' has {len(found)} values of {predicate}, but may have one")
        return found[0].o if found else None

    def mapping(self) -> Mapping:
        names = [node for node in list(self.values) if self.values[node].get(RML + "logicalSource")]
        if not names:
            raise MappingError("the statements hold no triples map")
        return Mapping(tuple(self.triples_map(name) for name in sorted(names)))

    def triples_map(self, name: str) -> TriplesMap:
        subjects = self.all(name, RR + "subjectMap")
        classes: tuple[str, ...] = ()
        graphs: tuple[TermMap, ...] = ()
        subject_terms = self.terms(name, "subject")
        if len(subject_terms) != 1:
            raise MappingError(f"triples map '{name}' needs exactly one subject map")
        for node in subjects:
            classes += tuple(row.o for row in self.all(node.o, RR + "class"))
            graphs += self.terms(node.o, "graph")
        pairs = tuple(self.pair(row.o) for row in self.all(name, RR + "predicateObjectMap"))
        return TriplesMap(name, self.source(name), subject_terms[0], classes, graphs, pairs)

    def source(self, name: str) -> Source:
        node = self.one(name, RML + "logicalSource")
        formulation = self.one(node, RML + "referenceFormulation")
        if formulation is not None and formulation not in FORMULATIONS:
            raise MappingError(f"unknown reference formulation {formulation}")
        location = self.all(node, RML + "source")
        if len(location) != 1:
            raise MappingError(f"the logical source of '{name}' needs exactly one rml:source")
        return Source(
            self.source_name(location[0]),
            FORMULATIONS.get(formulation, "table"),
            self.one(node, RML + "iterator"),
        )

    def source_name(self, location) -> str | None:
        """A path, or the name of a stream; a stream without a name is the unnamed input."""
        if location.o_kind == "literal":
            return location.o
        kinds = [row.o for row in self.all(location.o, RDF_TYPE)]
        if not any(kind.endswith(("/Stream", "#Stream")) for kind in kinds):
            raise MappingError(f"unsupported kind of source: {kinds or location.o}")
        names = [row.o for p, found in self.values[location.o].items() if p.endswith("streamName") for row in found]
        return names[0] if names else None

    def pair(self, node: str) -> PredicateObjectMap:
        return PredicateObjectMap(
            self.terms(node, "predicate"), self.terms(node, "object"), self.terms(node, "graph")
        )

    def terms(self, node: str, role: str) -> tuple:
        """Term maps of a role; the shortcut for a constant is normalised to a constant term map."""
        map_property, shortcut = SHORTCUTS[role]
        found = [self.term(row.o) for row in self.all(node, map_property)]
        for row in self.all(node, shortcut):
            found.append(self.constant(row))
        return tuple(found)

    @staticmethod
    def constant(row) -> TermMap:
        language = TermMap("constant", row.o_lang, LITERAL) if row.o_lang else None
        return TermMap("constant", row.o, {"iri": IRI, "bnode": BNODE}.get(row.o_kind, LITERAL), row.o_dt, language)

    def term(self, node: str):
        parent = self.one(node, RR + "parentTriplesMap")
        if parent is not None:
            joins = [row.o for row in self.all(node, RR + "joinCondition")]
            return ParentObject(
                parent, tuple(Join(self.one(j, RR + "child"), self.one(j, RR + "parent")) for j in joins)
            )
        constants = self.all(node, RR + "constant")
        if constants:
            return self.constant(constants[0])
        term_type = self.one(node, RR + "termType")
        languages = self.terms(node, "language")
        options = {
            "term_type": TERM_TYPES[term_type] if term_type else None,
            "datatype": self.one(node, RR + "datatype"),
            "language": languages[0] if languages else None,
        }
        function = self.one(node, FNML + "functionValue")
        if function is not None:
            return self.function(function, options)
        template = self.one(node, RR + "template")
        if template is not None:
            return TermMap("template", template, **options)
        reference = self.one(node, RML + "reference")
        reference = self.one(node, RR + "column") if reference is None else reference
        if reference is None:
            raise MappingError(f"term map '{node}' has no constant, reference, template or function")
        return TermMap("reference", reference, **options)

    def function(self, node: str, options: dict) -> TermMap:
        """A function value: one predicate-object map names the function, the others its parameters."""
        name, args = None, []
        for row in self.all(node, RR + "predicateObjectMap"):
            pair = self.pair(row.o)
            predicate, obj = pair.predicates[0].value, pair.objects[0]
            if predicate == FNO + "executes":
                name = obj.value
            else:
                args.append((predicate.replace("/", "#").rpartition("#")[2], obj))
        if name is None:
            raise MappingError(f"function value '{node}' does not say what it executes")
        return TermMap("function", name, args=tuple(sorted(args, key=lambda a: a[0])), **options)
