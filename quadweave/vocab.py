"""Vocabulary IRIs and other fixed values of the RDF and mapping specifications."""

DEFAULT_BASE_IRI = "http://example.com/base/"

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = RDF + "type"
RDF_FIRST = RDF + "first"
RDF_REST = RDF + "rest"
RDF_NIL = RDF + "nil"
RDF_LANG_STRING = RDF + "langString"

XSD = "http://www.w3.org/2001/XMLSchema#"
XSD_STRING = XSD + "string"
XSD_BOOLEAN = XSD + "boolean"
XSD_INTEGER = XSD + "integer"
XSD_DECIMAL = XSD + "decimal"
XSD_DOUBLE = XSD + "double"
XSD_DATE = XSD + "date"
XSD_DATETIME = XSD + "dateTime"
XSD_HEX_BINARY = XSD + "hexBinary"

# Mapping vocabularies (W3C R2RML, RML, its reference formulations, functions).
RR = "http://www.w3.org/ns/r2rml#"
RML = "http://semweb.mmlab.be/ns/rml#"
QL = "http://semweb.mmlab.be/ns/ql#"
FNML = "http://semweb.mmlab.be/ns/fnml#"
FNO = "https://w3id.org/function/ontology#"
DEFAULT_GRAPH = RR + "defaultGraph"

# Prefixes known without any prefix mapping file.
DEFAULT_PREFIXES = {
    "foaf": "http://xmlns.com/foaf/0.1/",
    "owl": "http://www.w3.org/2002/07/owl#",
    "rdf": RDF,
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "schema": "http://schema.org/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "xsd": XSD,
}
