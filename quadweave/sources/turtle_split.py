"""Turtle, TriG and N3 files read by many tasks.

Files are cut between statements, and outside of graph blocks; the states of a lexer, composed over the pieces of a
file, tell where that is, also next to long strings and comments (see ``lexed``). Prefixes are gathered per file and
handed to every piece. Files with a base, or with a prefix that has several meanings, are read whole, since what a statement
means then depends on its place.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.operators.schema import STATEMENT_COLUMNS
from quadweave.sources import lexed, rdf_documents
from quadweave.sources.files import broadcast_if_small, ensure_checkpoint_folder

PREFIX = r"(?i)(?:@prefix|(?:^|[\s.>])prefix)\s+([^\s:]*:)\s*<([^>]*)>"
BASE = r"(?i)@base\b|(?:^|[\s.>])base\s*<"


# Like the document parser, this travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def scan_turtle_pieces(
    spark: SparkSession, paths: list[str], *, graphs: bool = True, chunk: int = 1 << 20, most_prefixes: int = 1000
) -> DataFrame:
    """Statements in pieces of ``chunk`` characters at least; a file with more than ``most_prefixes`` is read whole.

    Without ``graphs``, braces have no meaning.
    """
    records = lexed.read_records(spark, paths, lexed.turtle_lexer(graphs), chunk)
    files = describe(records, most_prefixes)
    headed = records.join(broadcast_if_small(files.where("splits").select("file", "prefixes")), "file")
    # Blank nodes without a label are told apart by the place of their piece.
    headed = headed.withColumn("place", F.concat_ws("-", "block", "number"))
    cut = headed.mapInPandas(_parse_pieces, rdf_documents.DOCUMENT_SCHEMA)
    whole = files.where("NOT splits").select("file")
    if whole.isEmpty():
        return cut
    texts = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    uncut = rdf_documents.parse_documents(texts.join(broadcast_if_small(whole), "file", "left_semi"), "ttl")
    return cut.unionByName(uncut)


def describe(pieces: DataFrame, most_prefixes: int) -> DataFrame:
    """(file, splits, prefixes) for every file, checkpointed: both uses have to agree.

    A directive inside a literal counts as well; that may keep a file whole, but never cuts it wrongly.
    """
    ensure_checkpoint_folder(pieces.sparkSession)
    based = pieces.groupBy("file").agg(F.max(F.col("value").rlike(BASE)).alias("based"))
    names = F.regexp_extract_all("value", F.lit(PREFIX), 1)
    iris = F.regexp_extract_all("value", F.lit(PREFIX), 2)
    declared = (
        pieces.where(F.col("value").rlike("(?i)prefix"))
        .select("file", F.inline(F.arrays_zip(names.alias("name"), iris.alias("iri"))))
        .distinct()
    )
    sizes = declared.groupBy("file").agg(
        F.count(F.lit(1)).alias("declared"), F.count_distinct("name").alias("names")
    )
    clear = sizes.where((F.col("declared") == F.col("names")) & (F.col("declared") <= most_prefixes))
    # At most most_prefixes entries per file are gathered.
    gathered = (
        declared.join(clear, "file", "left_semi")
        .groupBy("file")
        .agg(F.map_from_entries(F.collect_list(F.struct("name", "iri"))).alias("prefixes"))
    )
    none = F.from_json(F.lit("{}"), "map<string,string>")
    return (
        based.join(sizes, "file", "left")
        .join(gathered, "file", "left")
        .select(
            "file",
            (~F.col("based") & (F.col("declared").isNull() | F.col("prefixes").isNotNull())).alias("splits"),
            F.coalesce("prefixes", none).alias("prefixes"),
        )
        .checkpoint()
    )


def _parse_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["file", *STATEMENT_COLUMNS]
    for batch in batches:
        rows: list[tuple] = []
        for file, text, place, prefixes in zip(batch["file"], batch["value"], batch["place"], batch["prefixes"]):
            rows += rdf_documents.parse_piece(text, file, place, dict(prefixes))
            if len(rows) >= rdf_documents.BATCH:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)
