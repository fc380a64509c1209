"""JSON-based RDF whose documents are lines: RDF/JSON and newline-delimited JSON-LD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.operators.schema import STATEMENT_COLUMNS
from quadweave.vocab import RDF_TYPE, XSD_BOOLEAN, XSD_DOUBLE, XSD_INTEGER, XSD_STRING

RDF_JSON_TYPE = "map<string,map<string,array<struct<type:string,value:string,lang:string,datatype:string>>>>"


def _texts(spark: SparkSession, paths: list[str], whole: bool) -> DataFrame:
    return (
        spark.read.option("recursiveFileLookup", True)
        .text(paths, wholetext=whole)
        .select("value", F.col("_metadata.file_path").alias("file"))
        .where(F.col("value").rlike(r"\S"))
    )


def _parsed(texts: DataFrame, dtype: str, *kept: str) -> DataFrame:
    """Documents as values of ``dtype``; text that is no such document is an error.

    The error is part of the value, because a filter on it might run after another one that the
    optimizer adds; and the generator keeps such filters from parsing the text once more.
    """
    message = F.concat(F.lit("Exception occurred while parsing "), F.col("file"))
    document = F.coalesce(F.from_json("value", dtype), F.raise_error(message).cast(dtype))
    return texts.select("file", *kept, F.explode(F.array(document)).alias("doc"))


def _is_bnode(name: Column) -> Column:
    return F.startswith(name, F.lit("_:"))


def _kind(name: Column) -> Column:
    return F.when(_is_bnode(name), "bnode").otherwise("iri")


def _label(name: Column) -> Column:
    return F.when(_is_bnode(name), F.substring(name, 3, 2**31 - 1)).otherwise(name)


def parse_rdf_json(texts: DataFrame) -> DataFrame:
    """Statements of a frame with ``value`` (an RDF/JSON document or part of one) and ``file``."""
    subjects = _parsed(texts, RDF_JSON_TYPE).select("file", F.explode("doc").alias("s", "ps"))
    predicates = subjects.select("file", "s", F.explode("ps").alias("p", "os"))
    objects = predicates.select("file", "s", "p", F.inline("os"))
    is_literal = F.col("type") == "literal"
    return objects.select(
        "file",
        _kind(F.col("s")).alias("s_kind"),
        _label(F.col("s")).alias("s"),
        "p",
        F.when(is_literal, "literal").otherwise(_kind(F.col("value"))).alias("o_kind"),
        F.when(is_literal, F.col("value")).otherwise(_label(F.col("value"))).alias("o"),
        F.when(is_literal & F.col("lang").isNull(), F.nullif("datatype", F.lit(XSD_STRING))).alias("o_dt"),
        F.when(is_literal, F.lower("lang")).alias("o_lang"),
        F.lit(None).cast("string").alias("g"),
    )


def scan_rdf_json(spark: SparkSession, paths: list[str], *, whole_documents: bool = False) -> DataFrame:
    """RDF/JSON, one object per line as the sink writes it, or one document per file."""
    return parse_rdf_json(_texts(spark, paths, whole_documents)).select("file", *STATEMENT_COLUMNS)


VALUE_OBJECT = "struct<`@id`:string,`@value`:string,`@type`:string,`@language`:string>"


def _expanded(rows: DataFrame, fine: Column, text: Column) -> DataFrame:
    """The rows, or an error where one is not expanded form."""
    message = F.concat(
        F.lit("Exception occurred while parsing "), F.col("file"), F.lit(": no expanded JSON-LD: "), F.coalesce(text, F.lit("null"))
    )
    return rows.where(F.when(fine, True).otherwise(F.raise_error(message).cast("boolean")))


def parse_ndjsonld(texts: DataFrame) -> DataFrame:
    """Statements of node objects in expanded form, one per line, in one pass over the lines.

    A node without ``@id`` is a blank node told apart by the place of its line. Anything that is not expanded form
    (contexts, lists, nested nodes, values outside arrays) is an error, never left out.
    """
    placed = texts.withColumn("place", F.monotonically_increasing_id())
    documents = _parsed(placed, "map<string,string>", "place")
    graph = F.col("doc")["@graph"]
    nodes = F.when(graph.isNull(), F.array("doc")).otherwise(F.from_json(graph, "array<map<string,string>>"))
    apart = F.forall(F.map_keys("doc"), lambda key: key.isin("@id", "@graph"))
    documents = _expanded(documents, graph.isNull() | (apart & nodes.isNotNull()), graph).select(
        "file",
        "place",
        F.when(graph.isNotNull(), F.col("doc")["@id"]).alias("g"),
        F.posexplode(nodes).alias("index", "node"),
    )
    own_label = F.format_string("_:[%d.%d]", "place", "index")
    keyed = documents.select(
        "file", F.coalesce(F.col("node")["@id"], own_label).alias("s"), "g", F.explode("node").alias("key", "json")
    )
    is_type = F.col("key") == "@type"
    keyed = keyed.where("key <> '@id'")
    in_array = F.col("json").isNull() | F.startswith(F.ltrim("json"), F.lit("["))
    keyed = _expanded(keyed, (is_type | ~F.startswith("key", F.lit("@"))) & in_array, F.col("json"))
    values = keyed.select(
        "file",
        "s",
        "g",
        is_type.alias("is_type"),
        F.when(is_type, RDF_TYPE).otherwise(F.col("key")).alias("p"),
        F.explode(F.from_json("json", "array<string>")).alias("raw"),
    )
    # The barrier keeps the value object from being parsed once per use.
    parsed = F.when(~F.col("is_type"), F.from_json("raw", VALUE_OBJECT))
    values = values.select("file", "s", "g", "p", "is_type", "raw", F.explode(F.array(parsed)).alias("value"))
    keys = F.json_object_keys("raw")
    reference = F.col("value")["@id"].isNotNull() & (F.size(keys) == 1)
    literal = F.col("value")["@value"].isNotNull() & F.forall(keys, lambda key: key.isin("@value", "@type", "@language"))
    values = _expanded(values, F.when(F.col("is_type"), F.col("raw").isNotNull()).otherwise(reference | literal), F.col("raw"))
    number_or_boolean = F.regexp_extract("raw", r'"@value"\s*:\s*(true|false|-?[0-9][0-9.eE+-]*)', 1)
    natural = (
        F.when(number_or_boolean.isin("true", "false"), XSD_BOOLEAN)
        .when(number_or_boolean.rlike(r"[.eE]"), XSD_DOUBLE)
        .when(number_or_boolean != "", XSD_INTEGER)
    )
    value = F.col("value")
    resource = F.when(F.col("is_type"), F.col("raw")).otherwise(value["@id"])
    is_literal = resource.isNull()
    language = F.lower(value["@language"])
    datatype = F.nullif(F.coalesce(value["@type"], natural), F.lit(XSD_STRING))
    return values.select(
        "file",
        _kind(F.col("s")).alias("s_kind"),
        _label(F.col("s")).alias("s"),
        "p",
        F.when(is_literal, "literal").otherwise(_kind(resource)).alias("o_kind"),
        F.when(is_literal, value["@value"]).otherwise(_label(resource)).alias("o"),
        F.when(is_literal & language.isNull(), datatype).alias("o_dt"),
        F.when(is_literal, language).alias("o_lang"),
        "g",
    )


def scan_ndjsonld(spark: SparkSession, paths: list[str]) -> DataFrame:
    return parse_ndjsonld(_texts(spark, paths, False)).select("file", *STATEMENT_COLUMNS)
