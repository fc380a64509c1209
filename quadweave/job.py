"""The whole way in one call: mapping documents and sources in, an RDF dataset out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping as MappingType, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quadweave.errors import MappingError
from quadweave.functions import FunctionRegistry
from quadweave.model import Mapping
from quadweave.operators.prefixes import namespaces
from quadweave.plans.output import output_format
from quadweave.sinks.text import WriteReport, render_rdf, write_rdf
from quadweave.sources.rdf import read_rdf
from quadweave.streaming.jobs import start_dataset_sink
from quadweave.vocab import DEFAULT_BASE_IRI


def map_to_rdf(
    spark: SparkSession,
    mapping: str | Sequence[str],
    *,
    mapping_format: str | None = None,
    sources: MappingType[str | None, DataFrame] | None = None,
    source_options: MappingType[str | None, MappingType[str, object]] | None = None,
    root: str | None = None,
    output: str | None = None,
    fmt: str = "nq",
    prefixes: str | Iterable[str] = (),
    prefix_mappings: Sequence[str] = (),
    pretty: bool = False,
    base_iri: str = DEFAULT_BASE_IRI,
    limit: int | None = None,
    functions: FunctionRegistry | None = None,
    configure: Sequence[Callable] = (),
    relabel: bool = False,
    checkpoint: str | None = None,
) -> WriteReport | DataFrame | StreamingQuery:
    """Apply mapping documents and write the statements below ``output``.

    ``mapping`` are files or directories of mapping documents, ``root`` is where relative source
    names start, and ``sources`` binds DataFrames to source names (``None`` is the unnamed input).
    ``source_options`` gives sources by name what documents can't say: declared keys (``unique``) and reader options.
    ``prefixes`` are ``p=iri`` declarations or names to look up in ``prefix_mappings``. Without an
    output the lines of the format come back as a DataFrame. If a bound source is a stream, ``checkpoint`` is the folder
    of its progress, and the running query that writes batch after batch comes back.
    """
    output_format(fmt)
    names = namespaces(spark, prefixes, prefix_mappings)
    described = Mapping.from_statements(read_rdf(spark, mapping, mapping_format, cut=False))
    statements = described.with_source_options(source_options or {}).run(
        spark, sources, root=root, base_iri=base_iri, limit=limit, functions=functions, configure=configure
    )
    if statements.isStreaming and output is not None:
        if checkpoint is None or relabel:
            raise MappingError("A streaming source needs a checkpoint folder, and blank nodes cannot be relabelled over batches")
        return start_dataset_sink(statements, output, checkpoint, fmt, prefixes=names, pretty=pretty)
    inline = pretty and output_format(fmt) in ("ttl", "ttls", "n3") and not relabel
    if output is None:
        return render_rdf(statements, fmt, prefixes=names, pretty=pretty, inline_bnodes=inline)
    return write_rdf(
        statements, output, fmt, prefixes=names, pretty=pretty, relabel=relabel, inline_bnodes=inline
    )
