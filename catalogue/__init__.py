"""The query catalogue over the driver tables: every operator once, with SQL that says the same."""

from catalogue import formats, maps, statements, streams
from catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "formats", "maps", "statements", "streams"]
