"""RDF sinks."""
