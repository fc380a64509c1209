"""TriX: graph elements as records, their triples taken apart with built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.operators.schema import STATEMENT_COLUMNS
from quadweave.sources.files import broadcast_if_small, ensure_checkpoint_folder
from quadweave.vocab import XSD_STRING

GRAPH_NAME = r"<graph[^>]*>\s*<(uri|id)>([^<]*)</"
TRIPLE = (
    r"^\s*<(uri|id)>([^<]*)</(?:uri|id)>\s*<uri>([^<]*)</uri>\s*"
    r"<(uri|id|plainLiteral|typedLiteral)((?:\s+[\w:]+=\"[^\"]*\")*)\s*(?:/>|>([^<]*)</(?:uri|id|plainLiteral|typedLiteral)>)\s*$"
)


def unescape_xml(value: Column) -> Column:
    # The predefined XML entities; the ampersand has to come last.
    pairs = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#13;", "\r"), ("&amp;", "&"))
    plain = reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), pairs, value)
    # Other numeric references are rare; an XML parser knows them all.
    rare = F.contains(F.replace(value, F.lit("&#13;"), F.lit("")), F.lit("&#"))
    parsed = F.xpath_string(F.concat(F.lit("<v>"), value, F.lit("</v>")), F.lit("/v"))
    return F.when(rare, parsed).when(F.contains(value, F.lit("&")), plain).otherwise(value)


def _graph_name(tag: Column, text: Column) -> Column:
    name = F.when(tag == "id", F.concat(F.lit("_:"), text)).otherwise(unescape_xml(text))
    return F.nullif(name, F.lit(""))


def parse_graph_elements(records: DataFrame) -> DataFrame:
    """Statements of a frame with ``value`` (text up to the end of one graph element) and ``file``."""
    name = _graph_name(F.regexp_extract("value", GRAPH_NAME, 1), F.regexp_extract("value", GRAPH_NAME, 2))
    # Every piece but the last ends where a triple element ends.
    pieces = F.split("value", "</triple>")
    triples = records.select(
        "file", name.alias("g"), F.explode(F.slice(pieces, F.lit(1), F.size(pieces) - 1)).alias("piece")
    )
    return parse_triples(triples.select("file", "g", F.substring_index("piece", "<triple>", -1).alias("triple")))


def parse_triples(triples: DataFrame) -> DataFrame:
    """Statements of a frame with ``triple`` (the content of a triple element), ``g`` and ``file``."""
    message = F.concat(F.lit("Exception occurred while parsing "), F.col("file"), F.lit(": "), F.col("triple"))
    triples = triples.where(
        F.when(F.col("triple").rlike(TRIPLE), True).otherwise(F.raise_error(message).cast("boolean"))
    )

    def group(index: int) -> Column:
        return F.regexp_extract("triple", TRIPLE, index)

    def kind(tag: Column) -> Column:
        return F.when(tag == "uri", "iri").when(tag == "id", "bnode").otherwise("literal")

    datatype = unescape_xml(F.regexp_extract(group(5), r'datatype="([^"]*)"', 1))
    language = F.lower(F.regexp_extract(group(5), r'xml:lang="([^"]*)"', 1))
    return triples.select(
        "file",
        kind(group(1)).alias("s_kind"),
        unescape_xml(group(2)).alias("s"),
        unescape_xml(group(3)).alias("p"),
        kind(group(4)).alias("o_kind"),
        unescape_xml(group(6)).alias("o"),
        F.nullif(F.nullif(datatype, F.lit("")), F.lit(XSD_STRING)).alias("o_dt"),
        F.nullif(language, F.lit("")).alias("o_lang"),
        "g",
    )


def _records(spark: SparkSession, paths: list[str], end: str) -> DataFrame:
    """(value, file): text up to each end tag, without comments.

    A comment that holds the end tag can't be told from text here, nor can a CDATA section: both are errors.
    """
    records = (
        spark.read.option("recursiveFileLookup", True)
        .text(paths, lineSep=end)
        .select("value", F.col("_metadata.file_path").alias("file"))
    )
    bare = F.when(F.contains("value", F.lit("<!--")), F.regexp_replace("value", "(?s)<!--.*?-->", "")).otherwise(F.col("value"))
    message = F.concat(F.lit("Exception occurred while parsing "), F.col("file"), F.lit(": a CDATA section, or an end tag in a comment"))
    hidden = F.contains("value", F.lit("<!--")) | F.contains("value", F.lit("<![CDATA["))
    return records.select(bare.alias("value"), "file").select(
        F.when(hidden, F.raise_error(message).cast("string")).otherwise(F.col("value")).alias("value"), "file"
    )


def scan_graphs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A record ends with a graph element, so files split between graphs."""
    return parse_graph_elements(_checked(_records(spark, paths, "</graph>"))).select("file", *STATEMENT_COLUMNS)


def _checked(records: DataFrame) -> DataFrame:
    around = r"^\s*(?:<\?xml[^>]*>\s*)?(?:</?TriX[^>]*>\s*)*$"
    message = F.concat(F.lit("Exception occurred while parsing "), F.col("file"))
    fine = F.contains("value", F.lit("<graph")) | F.col("value").rlike(around)
    return records.where(F.when(fine, True).otherwise(F.raise_error(message).cast("boolean")))


def scan_large_graphs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A record ends with a triple element. Its graph is only known without looking at its neighbours
    when the whole file names a single one; files with several graphs are cut between those."""
    ensure_checkpoint_folder(spark)
    pieces = _records(spark, paths, "</triple>")
    start = r"<graph[^>]*>\s*(?:<(uri|id)>([^<]*)</)?"
    tags, texts = (F.regexp_extract_all("value", F.lit(start), i) for i in (1, 2))
    names = (
        pieces.where(F.contains("value", F.lit("<graph")))
        .select("file", F.inline(F.arrays_zip(tags.alias("tag"), texts.alias("text"))))
        .select("file", _graph_name(F.col("tag"), F.col("text")).alias("g"))
    )
    # NULL is the default graph, which min and max do not see.
    files = (
        names.groupBy("file")
        .agg(F.min("g").alias("g"), F.max("g").alias("last"), F.max(F.col("g").isNull()).alias("default"))
        .select(
            "file",
            "g",
            ((F.col("g").isNull() | (F.col("g") == F.col("last"))) & ~(F.col("default") & F.col("g").isNotNull())).alias(
                "single"
            ),
        )
        .checkpoint()
    )
    single = broadcast_if_small(files.where("single").select("file", "g"))
    several = broadcast_if_small(files.where("NOT single").select("file"))
    triples = pieces.where(F.contains("value", F.lit("<triple>"))).join(single, "file")
    cut = parse_triples(triples.select("file", "g", F.substring_index("value", "<triple>", -1).alias("triple")))
    records = _records(spark, paths, "</graph>")
    rest = parse_graph_elements(_checked(records.join(several, "file", "left_semi")))
    return cut.select("file", *STATEMENT_COLUMNS).unionByName(rest.select("file", *STATEMENT_COLUMNS))
