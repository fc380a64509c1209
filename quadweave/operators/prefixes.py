"""Prefix mappings: loading, resolving declarations, and shortening IRIs."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.errors import PrefixError
from quadweave.sources.files import list_files
from quadweave.vocab import DEFAULT_PREFIXES

LOG = logging.getLogger(__name__)
LOCAL_NAME = r"^$|^[A-Za-z0-9_](?:[A-Za-z0-9_.-]*[A-Za-z0-9_-])?$"

# --- loading -----------------------------------------------------------------------------------


def prefixes_from_documents(documents: DataFrame) -> DataFrame:
    """Prefixes of many mapping documents; the document with the highest ordinal wins.

    ``documents`` has ``ordinal``, ``format`` (``json`` or ``yaml``) and ``value`` (the content).
    """
    entries = F.when(
        F.col("format") == "json", F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
    ).otherwise(_flat_yaml(F.col("value")))
    return (
        documents.select("ordinal", F.explode(entries).alias("prefix", "iri"))
        .groupBy("prefix")
        .agg(F.max_by("iri", "ordinal").alias("iri"))
    )


def _flat_yaml(text: Column) -> Column:
    """A flat ``key: value`` document as a map; later keys win.

    A value in quotes ends with them; any other ends before a `` #`` comment. Indented lines, and values that are
    lists, maps, anchors, tags or blocks, are errors.
    """
    lines = F.filter(F.split(text, r"\r?\n"), lambda line: ~F.rlike(line, F.lit(r"^\s*(#.*)?$|^---\s*$")))
    pattern = r"""^("[^"]+"|'[^']+'|[^\s"'#\[{&*!|>?-][^\s"']*?)\s*:\s+("[^"]*"|'[^']*'|[^\s"'#\[{&*!|>].*?)(?:\s+#.*|\s*)$"""

    def unquote(part: Column) -> Column:
        return F.regexp_replace(part, "^([\"'])(.*)\\1$", "$2")

    def entry(line: Column) -> Column:
        bad = F.raise_error(F.concat(F.lit("not a flat YAML mapping: "), line)).cast("string")
        value = unquote(F.regexp_extract(line, pattern, 2))
        return F.struct(unquote(F.regexp_extract(line, pattern, 1)), F.when(F.rlike(line, F.lit(pattern)), value).otherwise(bad))

    return F.map_from_entries(F.transform(lines, entry))


def load_prefixes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Prefix mapping files, or all files below directories, as (prefix, iri); later files win."""
    files = [path for given in paths for path in list_files(spark, given)]
    formats = {"json": "json", "yaml": "yaml", "yml": "yaml"}
    rows = []
    for ordinal, path in enumerate(files):
        name = path.rsplit("/", 1)[-1]
        extension = name.rsplit(".", 1)[-1] if "." in name else ""
        if extension not in formats:
            raise PrefixError(
                f"Could not determine prefix mapping file format for [{path}]: known extensions are {sorted(formats)}"
            )
        rows.append((path, ordinal, formats[extension]))
    if not rows:
        return spark.createDataFrame([], "prefix string, iri string")
    listing = F.broadcast(spark.createDataFrame(rows, "path string, ordinal int, format string"))
    contents = spark.read.text(files, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    same = F.regexp_replace(contents["path"], "^file:/+", "/") == F.regexp_replace(listing["path"], "^file:/+", "/")
    return prefixes_from_documents(contents.join(listing, same).select("ordinal", "format", "value"))


# --- resolving ---------------------------------------------------------------------------------


def resolve_declarations(declarations: DataFrame, known: DataFrame) -> DataFrame:
    """Inline ``p=iri`` declarations and looked-up references as (prefix, iri, resolved).

    Rows with ``resolved = false`` are references nobody declares; callers report and drop them.
    """
    parts = F.split("declaration", "=", 2)
    split = declarations.select(parts[0].alias("prefix"), F.get(parts, F.lit(1)).alias("inline"))
    table = known.select(F.col("prefix").alias("_known"), F.col("iri").alias("_iri"))
    joined = split.join(table, F.col("prefix") == F.col("_known"), "left")
    iri = F.coalesce("inline", "_iri")
    return joined.select("prefix", iri.alias("iri"), iri.isNotNull().alias("resolved"))


def namespaces(
    spark: SparkSession, declarations: str | Iterable[str], mapping_files: Sequence[str] = ()
) -> dict[str, str]:
    """The prefixes to use in an output: a small driver-side dictionary.

    Files are only read when a declaration refers to them; without files the default prefixes apply.
    """
    listed = declarations.split(",") if isinstance(declarations, str) else list(declarations)
    listed = [item for item in listed if item]
    inline = [item.partition("=") for item in listed]
    names = [name for name, _, _ in inline]
    repeated = sorted({name for name in names if names.count(name) > 1})
    if repeated:
        raise PrefixError(f"prefix declared more than once: {', '.join(repeated)}")
    wanted = [name for name, equals, _ in inline if not equals]
    known: dict[str, str] = {}
    if wanted and mapping_files:
        table = load_prefixes(spark, mapping_files)
        try:
            # At most one row per wanted name comes back.
            rows = table.where(F.col("prefix").isin(wanted)).collect()
        except Exception as error:
            raise PrefixError(f"Could not parse prefix mapping file [{', '.join(mapping_files)}].") from error
        known = {row.prefix: row.iri for row in rows}
    elif wanted:
        known = DEFAULT_PREFIXES
    result: dict[str, str] = {}
    for name, equals, iri in inline:
        if equals:
            result[name] = iri
        elif name in known:
            result[name] = known[name]
        else:
            LOG.warning("Prefix reference `%s` could not be resolved.", name)
    return result


# --- shortening --------------------------------------------------------------------------------


def compact_iri(iri: Column, prefixes: Mapping[str, str]) -> Column:
    """``prefix:local`` where a namespace fits and the rest is a plain local name, else ``<iri>``."""
    result = F.concat(F.lit("<"), iri, F.lit(">"))
    # The longest namespace has to be tested first, so it is wrapped around last.
    for name, namespace in sorted(prefixes.items(), key=lambda item: (len(item[1]), item[0])):
        local = F.substring(iri, len(namespace) + 1, 2**31 - 1)
        fits = F.startswith(iri, F.lit(namespace)) & local.rlike(LOCAL_NAME)
        result = F.when(fits, F.concat(F.lit(name + ":"), local)).otherwise(result)
    return result


def compact_column(frame: DataFrame, column: str, prefixes: DataFrame) -> DataFrame:
    """Shorten with a prefix table too large for an expression: joined on the namespace part.

    Namespaces may end anywhere, and hold one another: of those that an IRI starts with and that leave a plain local
    name, the longest is used. Every different IRI is cut at the lengths that namespaces have, and what stands
    before the cut is looked up. When two prefixes name one namespace, the first by name is used. Spark picks the joins by
    measured size.
    """
    chosen = prefixes.groupBy(F.col("iri").alias("_ns")).agg(F.min("prefix").alias("_prefix"))
    lengths = chosen.agg(F.collect_set(F.length("_ns"))).scalar()
    fits = frame.select(F.col(column).alias("_iri")).where("_iri IS NOT NULL").distinct().withColumn("_n", F.explode(lengths))
    local = F.substring(F.col("_iri"), F.col("_n") + 1, F.lit(2**31 - 1))
    cut = fits.where((F.col("_n") <= F.length("_iri")) & local.rlike(LOCAL_NAME))
    found = cut.join(chosen, F.substring(F.col("_iri"), F.lit(1), F.col("_n")) == F.col("_ns"))
    longest = found.groupBy("_iri").agg(F.max_by(F.concat(F.col("_prefix"), F.lit(":"), local), "_n").alias("_short"))
    joined = frame.join(longest, F.col(column) == F.col("_iri"), "left")
    full = F.concat(F.lit("<"), F.col(column), F.lit(">"))
    return joined.withColumn(column, F.coalesce("_short", full)).drop("_iri", "_short")
