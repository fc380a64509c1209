"""N-Triples and N-Quads: a splittable text scan, parsed with built-in expressions only.

The parse walks a line from the left with plain text searches. Literals can be very long, so their
end is never looked for with a backtracking pattern: escaped characters are masked by others of the
same length, after which the next quote is the closing one. Every intermediate result is a column
of its own, so it is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.operators.schema import STATEMENT_COLUMNS
from quadweave.vocab import XSD_STRING

BNODE_LABEL = r"^_:[^\s<>\"]*[^\s<>\".]"
REST = 2**31 - 1


def unescape(text: Column) -> Column:
    """Undo ``\\t \\n \\" \\uXXXX \\UXXXXXXXX`` and the like.

    JSON strings share all these escapes but ``\\'`` and ``\\U``, so the JSON parser does the work.
    """

    def as_json(part: Column) -> Column:
        quoted = F.concat(F.lit('["'), part, F.lit('"]'))
        return F.from_json(quoted, "array<string>", {"allowUnquotedControlChars": "true"})[0]

    def short(part: Column) -> Column:
        return as_json(F.replace(part, F.lit("\\'"), F.lit("'")))

    def segment(part: Column) -> Column:
        pieces = F.transform(
            F.split(part, r"\\U"),
            lambda piece, i: F.when(i == 0, short(piece)).otherwise(
                F.concat(
                    F.decode(F.unhex(F.substring(piece, 1, 8)), "UTF-32"),
                    short(F.substring(piece, 9, REST)),
                )
            ),
        )
        return F.array_join(pieces, "")

    # Pairs of backslashes are split off first, so that one before a U is not taken for an escape.
    rare = F.array_join(F.transform(F.split(text, r"\\\\"), segment), "\\")
    has_rare = F.contains(text, F.lit("\\U")) | F.contains(text, F.lit("\\'"))
    return F.when(has_rare, rare).otherwise(as_json(text))


def _skip_blanks(text: Column) -> Column:
    return F.ltrim(text, F.lit(" \t"))


def _resource_end(text: str) -> Column:
    """Length of the IRI or blank node a column starts with, 0 if there is none."""
    column = F.col(text)
    return (
        F.when(F.startswith(column, F.lit("<")), F.locate(">", column))
        .when(F.startswith(column, F.lit("_:")), F.length(F.regexp_extract(column, BNODE_LABEL, 0)))
        .otherwise(0)
    )


def _from(text: str, position: Column) -> Column:
    return F.substring(F.col(text), position, F.lit(REST))


def _bare(term: Column) -> Column:
    """An IRI without its brackets; anything else as it is."""
    return F.when(F.startswith(term, F.lit("<")), F.substring(term, F.lit(2), F.length(term) - 2)).otherwise(term)


def parse_lines(lines: DataFrame, *, graphs: bool = True) -> DataFrame:
    """Statements of a frame with ``value`` (a line) and ``file``. A malformed line is an error."""
    frame = lines.select("file", _skip_blanks(F.col("value")).alias("_line"))
    frame = frame.where((F.col("_line") != "") & ~F.startswith("_line", F.lit("#")))
    frame = frame.withColumn("_s_end", _resource_end("_line"))
    frame = frame.select(
        "file",
        "_line",
        F.substring(F.col("_line"), F.lit(1), F.col("_s_end")).alias("_s"),
        _skip_blanks(_from("_line", F.col("_s_end") + 1)).alias("_rest1"),
    )
    frame = frame.withColumn(
        "_p_end", F.when(F.startswith("_rest1", F.lit("<")), F.locate(">", F.col("_rest1"))).otherwise(0)
    )
    frame = frame.select(
        "file",
        "_line",
        "_s",
        F.substring(F.col("_rest1"), F.lit(1), F.col("_p_end")).alias("_p"),
        _skip_blanks(_from("_rest1", F.col("_p_end") + 1)).alias("_rest2"),
    )
    masked = F.replace(F.replace(F.col("_rest2"), F.lit("\\\\"), F.lit("__")), F.lit('\\"'), F.lit("__"))
    masked = F.when(F.contains("_rest2", F.lit("\\")), masked).otherwise(F.col("_rest2"))
    frame = frame.withColumn("_is_literal", F.startswith("_rest2", F.lit('"')))
    frame = frame.withColumn(
        "_o_end", F.when(F.col("_is_literal"), F.locate('"', masked, 2)).otherwise(_resource_end("_rest2"))
    )
    frame = frame.select(
        "file",
        "_line",
        "_s",
        "_p",
        "_is_literal",
        "_o_end",
        F.substring(F.col("_rest2"), F.lit(1), F.col("_o_end")).alias("_o"),
        _from("_rest2", F.col("_o_end") + 1).alias("_tail"),
    )
    suffix = (
        F.when(~F.col("_is_literal"), "")
        .when(F.startswith("_tail", F.lit("^^<")), F.substring_index("_tail", ">", 1))
        .when(F.startswith("_tail", F.lit("@")), F.regexp_extract("_tail", r"^@[A-Za-z]+(?:-[A-Za-z0-9]+)*", 0))
        .otherwise("")
    )
    frame = frame.withColumn("_suffix", suffix)
    after = F.length("_suffix") + F.when(F.startswith("_suffix", F.lit("^")), 2).otherwise(1)
    frame = frame.withColumn("_rest3", _skip_blanks(_from("_tail", after)))
    frame = frame.withColumn("_g_end", _resource_end("_rest3"))
    frame = frame.withColumn("_g", F.substring(F.col("_rest3"), F.lit(1), F.col("_g_end")))
    frame = frame.withColumn("_end", _skip_blanks(_from("_rest3", F.col("_g_end") + 1)))
    well_formed = (
        (F.length("_s") > 0)
        & (F.length("_p") > 0)
        & (F.col("_o_end") > 0)
        & ((F.col("_end") == ".") | F.col("_end").rlike(r"^\.\s*(?:#.*)?$"))
    )
    if not graphs:
        well_formed = well_formed & (F.col("_g_end") == 0)
    message = F.concat(F.lit("Exception occurred while parsing "), F.col("file"), F.lit(": "), F.col("_line"))
    predicate = F.when(well_formed, _bare(F.col("_p"))).otherwise(F.raise_error(message).cast("string"))

    lexical = F.substring(F.col("_o"), F.lit(2), F.col("_o_end") - 2)
    raw = F.array(
        _bare(F.col("_s")),
        predicate,
        F.when(F.col("_is_literal"), lexical).otherwise(_bare(F.col("_o"))),
        F.when(F.startswith("_suffix", F.lit("^")), F.substring("_suffix", 4, REST)),
        F.nullif(_bare(F.col("_g")), F.lit("")),
    )
    frame = frame.select(
        "file",
        "_line",
        F.startswith("_s", F.lit("<")).alias("_s_iri"),
        F.startswith("_o", F.lit("<")).alias("_o_iri"),
        "_is_literal",
        F.when(F.startswith("_suffix", F.lit("@")), F.lower(F.substring("_suffix", 2, REST))).alias("_lang"),
        raw.alias("_raw"),
    )
    terms = F.when(F.contains("_line", F.lit("\\")), F.transform("_raw", unescape)).otherwise(F.col("_raw"))
    frame = frame.withColumn("_terms", terms)

    def term(index: int) -> Column:
        return F.col("_terms")[index]

    def label(index: int) -> Column:
        return F.substring(term(index), 3, REST)

    return frame.select(
        "file",
        F.when(F.col("_s_iri"), "iri").otherwise("bnode").alias("s_kind"),
        F.when(F.col("_s_iri"), term(0)).otherwise(label(0)).alias("s"),
        term(1).alias("p"),
        F.when(F.col("_is_literal"), "literal").when(F.col("_o_iri"), "iri").otherwise("bnode").alias("o_kind"),
        F.when(F.col("_is_literal") | F.col("_o_iri"), term(2)).otherwise(label(2)).alias("o"),
        F.nullif(term(3), F.lit(XSD_STRING)).alias("o_dt"),
        F.col("_lang").alias("o_lang"),
        term(4).alias("g"),
    )


def scan_lines(spark: SparkSession, paths: list[str], *, graphs: bool) -> DataFrame:
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .text(paths)
        .select("value", F.col("_metadata.file_path").alias("file"))
    )
    return parse_lines(lines, graphs=graphs).select("file", *STATEMENT_COLUMNS)
