"""Scans: logical sources for mappings, and RDF documents."""
