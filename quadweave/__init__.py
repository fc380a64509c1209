"""quadweave: declarative mappings from tables, files and streams to RDF statements, as Spark jobs."""

from quadweave.job import map_to_rdf
from quadweave.model import (
    Join,
    Mapping,
    ParentObject,
    PredicateObjectMap,
    Source,
    TermMap,
    TriplesMap,
    call,
    const,
    csv_source,
    json_source,
    literal,
    parent,
    ref,
    table,
    template,
    triples_map,
    xml_source,
)

__all__ = [
    "Join",
    "Mapping",
    "ParentObject",
    "PredicateObjectMap",
    "Source",
    "TermMap",
    "TriplesMap",
    "call",
    "const",
    "csv_source",
    "json_source",
    "literal",
    "map_to_rdf",
    "parent",
    "ref",
    "table",
    "template",
    "triples_map",
    "xml_source",
]
