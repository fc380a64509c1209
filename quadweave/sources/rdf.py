"""RDF documents as statement DataFrames: format choice, multi-file load, blank-node scope."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.errors import FormatError
from quadweave.operators.schema import STATEMENT_COLUMNS, no_statements
from quadweave.sources import rdf_documents, rdf_json, rdf_lines, rdf_xml, turtle_split
from quadweave.sources.files import list_files, require_path

# Format names and the file extensions that mean them.
EXTENSIONS = {
    "ttl": ("ttl",),
    "ttls": ("ttls",),
    "nt": ("nt",),
    "nq": ("nq",),
    "rdf": ("rdf", "rdfs", "owl"),
    "jsonld": ("jsonld",),
    "ndjsonld": ("ndjsonld", "jsonl", "ndjson"),
    "trig": ("trig",),
    "trigs": ("trigs",),
    "n3": ("n3",),
    "trix": ("trix", "xml"),
    "rj": ("rj",),
}

TURTLE_FAMILY = ("ttl", "ttls", "n3", "trig", "trigs")

SCANS: dict[str, Callable[[SparkSession, list[str]], DataFrame]] = {
    "nt": lambda spark, paths: rdf_lines.scan_lines(spark, paths, graphs=False),
    "nq": lambda spark, paths: rdf_lines.scan_lines(spark, paths, graphs=True),
    "rj": rdf_json.scan_rdf_json,
    "ndjsonld": rdf_json.scan_ndjsonld,
    "trix": lambda spark, paths: scan_trix(spark, paths),
    **{
        name: (lambda spark, paths, name=name: rdf_documents.scan_documents(spark, paths, name))
        for name in ("rdf", "jsonld")
    },
    **dict.fromkeys(TURTLE_FAMILY, lambda spark, paths: scan_turtle(spark, paths)),
    "ttl": lambda spark, paths: scan_turtle(spark, paths, graphs=False),
}


def scan_turtle(spark: SparkSession, paths: list[str], cut: bool = True, graphs: bool = True) -> DataFrame:
    """Documents are cut between statements, whatever their size; without ``cut`` each is one task's row."""
    if cut:
        return turtle_split.scan_turtle_pieces(spark, _visible_files(spark, paths), graphs=graphs)
    return rdf_documents.scan_documents(spark, paths, "ttl")


def scan_trix(spark: SparkSession, paths: list[str], cut: bool = False) -> DataFrame:
    """Documents are cut between graphs; with ``cut`` between triples where a document holds a single graph."""
    return rdf_xml.scan_large_graphs(spark, _visible_files(spark, paths)) if cut else rdf_xml.scan_graphs(spark, paths)


def scan_rdf_json(spark: SparkSession, paths: list[str], cut: bool = True) -> DataFrame:
    """An object per line, as the sink writes it; without ``cut`` a file is one document with any line breaks."""
    return rdf_json.scan_rdf_json(spark, paths, whole_documents=not cut)


#: Scans that can cut documents finer, or not at all, if the caller asks for it.
CUT_SCANS = {"trix": scan_trix, "rj": scan_rdf_json, **dict.fromkeys(TURTLE_FAMILY, scan_turtle)}


def _visible_files(spark: SparkSession, paths: list[str]) -> list[str]:
    return [f for p in paths for f in list_files(spark, p) if _is_visible(f)]


def format_by_extension(path: str) -> str:
    extension = path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else ""
    for name, extensions in EXTENSIONS.items():
        if extension in extensions:
            return name
    raise FormatError(f"Could not determine mapping format by file extension for path '{path}'")


def read_rdf(
    spark: SparkSession, paths: str | Sequence[str], fmt: str | None = None, *, distinct: bool = True, cut: bool | None = None
) -> DataFrame:
    """The statements of all files at or below ``paths``, as a set.

    An explicit format holds for every file; otherwise each file's extension decides. A blank-node
    label means the same node only within one file. ``distinct=False`` leaves out the shuffle when
    copies do not matter. Turtle, TriG and N3 documents are read in pieces, whatever their size, unless
    ``cut`` is False; TriX documents are cut between graphs, and with ``cut=True`` between triples. RDF/JSON is
    an object per line, with ``cut=False`` a document per file.
    """
    if fmt is not None and fmt not in SCANS:
        raise FormatError(f"Could not determine RDFFormat for `{fmt}`")
    given = [paths] if isinstance(paths, str) else list(paths)
    by_format: dict[str, list[str]] = {}
    for location in given:
        if fmt is not None:
            require_path(spark, location)
            by_format.setdefault(fmt, []).append(location)
            continue
        for path in list_files(spark, location):
            if _is_visible(path):
                by_format.setdefault(format_by_extension(path), []).append(path)
    if not by_format:
        return no_statements(spark)
    scans = [
        scope_bnodes(
            CUT_SCANS[name](spark, files, cut=cut) if cut is not None and name in CUT_SCANS else SCANS[name](spark, files)
        )
        for name, files in by_format.items()
    ]
    statements = reduce(DataFrame.unionByName, scans)
    return statements.dropDuplicates() if distinct else statements


def _is_visible(path: str) -> bool:
    """Job markers and other hidden files are no data."""
    return not path.rsplit("/", 1)[-1].startswith(("_", "."))


def scope_bnodes(parsed: DataFrame) -> DataFrame:
    """Replace document labels by labels of the document's own: a hash of file and label."""

    def scoped(label: Column) -> Column:
        return F.substring(F.sha2(F.concat(F.col("file"), F.lit("#"), label), 256), 1, 32)

    graph_is_bnode = F.startswith("g", F.lit("_:"))
    columns = {
        "s": F.when(F.col("s_kind") == "bnode", scoped(F.col("s"))).otherwise(F.col("s")),
        "o": F.when(F.col("o_kind") == "bnode", scoped(F.col("o"))).otherwise(F.col("o")),
        "g": F.when(graph_is_bnode, scoped(F.substring("g", 3, 2**31 - 1))).otherwise(F.col("g")),
    }
    return parsed.select(*[columns.get(name, F.col(name)).alias(name) for name in STATEMENT_COLUMNS])
