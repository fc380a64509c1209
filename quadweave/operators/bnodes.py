"""Blank nodes: sequential labels, and inlining in pretty Turtle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.operators import rendering
from quadweave.operators.grouping import MAX_GROUP, predicate_lists, with_parts
from quadweave.operators.schema import STATEMENT_COLUMNS
from quadweave.sources.files import ensure_checkpoint_folder


def sequential_labels(statements: DataFrame) -> DataFrame:
    """(label, number) for every blank node: numbers from 0 in label order, without a global window.

    Labels are range-partitioned and sorted; a label's number is its place in its partition plus the
    sizes of the partitions before it. The partitioning is checkpointed, so both halves see the same.
    """
    spark = statements.sparkSession
    ensure_checkpoint_folder(spark)
    subjects = statements.where(F.col("s_kind") == "bnode").select(F.col("s").alias("label"))
    objects = statements.where(F.col("o_kind") == "bnode").select(F.col("o").alias("label"))
    labels = subjects.unionByName(objects).distinct()
    placed = labels.repartitionByRange("label").sortWithinPartitions("label")
    row_id = F.monotonically_increasing_id()
    placed = placed.select("label", row_id.alias("_id")).checkpoint()
    placed = placed.select(
        "label", F.shiftright("_id", 33).alias("_partition"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_place")
    )
    sizes = placed.groupBy("_partition").agg(F.count(F.lit(1)).alias("_size"))
    # One row per partition: the running total below never sees more rows than there are partitions.
    before = sizes.select(
        "_partition",
        F.expr("coalesce(sum(_size) over (order by _partition rows between unbounded preceding and 1 preceding), 0)")
        .alias("_offset"),
    )
    return placed.join(F.broadcast(before), "_partition").select(
        "label", (F.col("_place") + F.col("_offset")).alias("number")
    )


def relabel(statements: DataFrame) -> DataFrame:
    """Replace blank-node labels by ``b0``, ``b1``, ... in label order."""
    labels = sequential_labels(statements).select(
        F.col("label").alias("_label"), F.concat(F.lit("b"), F.col("number").cast("string")).alias("_new")
    )
    result = statements
    for kind, column in (("s_kind", "s"), ("o_kind", "o")):
        # Terms that are no blank nodes get keys that match nothing and spread over all partitions.
        key = F.when(F.col(kind) == "bnode", F.col(column)).otherwise(
            F.concat(F.lit("<"), F.xxhash64(*STATEMENT_COLUMNS).cast("string"))
        )
        renamed = labels.toDF("_label", "_new")
        joined = result.withColumn("_key", key).join(renamed, F.col("_key") == F.col("_label"), "left")
        result = joined.withColumn(column, F.coalesce("_new", column)).select(*STATEMENT_COLUMNS)
    return result


def _is_bnode(kind: str) -> Column:
    return F.col(kind) == "bnode"


def inlined_blocks(
    statements: DataFrame, prefixes: Mapping[str, str] | None = None, max_group: int | None = MAX_GROUP
) -> DataFrame:
    """Turtle blocks of one graph with blank nodes written in place, as (s_kind, s, block).

    A blank node nobody refers to becomes ``[]`` as a subject. One that is referred to once becomes
    ``[ ... ]`` (or ``[]``) where it is used, unless its own block refers to blank nodes again:
    deeper levels keep their labels, and so do nodes of more than ``max_group`` statements. Subjects are cut by
    what is written for them, nodes in place included. The result means the same whichever way a node is written.
    """
    statements = statements.select(*STATEMENT_COLUMNS).dropDuplicates()
    uses = (
        statements.where(_is_bnode("o_kind")).groupBy(F.col("o").alias("label")).agg(F.count(F.lit(1)).alias("uses"))
    )
    subjects = (
        statements.where(_is_bnode("s_kind"))
        .groupBy(F.col("s").alias("label"))
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.max((F.col("o_kind") == "bnode").cast("int")).alias("refers"),
        )
    )
    nodes = uses.join(subjects, "label", "full").select(
        "label",
        F.coalesce("uses", F.lit(0)).alias("uses"),
        F.coalesce("size", F.lit(0)).alias("size"),
        F.coalesce("refers", F.lit(0)).alias("refers"),
    )
    # An inlined block sits inside one row of its referrer, so the bound of a block holds for it too.
    in_place = nodes.where((F.col("uses") == 1) & (F.col("refers") == 0))
    if max_group is not None:
        in_place = in_place.where(F.col("size") <= max_group)
    entry = F.struct(
        rendering.predicate_text(prefixes, shorthand=True).alias("p"), rendering.object_text(prefixes).alias("o")
    )
    keyed = statements.where(_is_bnode("s_kind")).join(
        in_place.select(F.col("label").alias("s")), "s", "left_semi"
    )
    bodies = keyed.groupBy("s").agg(F.sort_array(F.collect_set(entry)).alias("entries"))
    body = predicate_lists(F.col("entries"), "p", "o", next_predicate=" ; ", next_object=", ")
    written = in_place.join(
        bodies.select(F.col("s").alias("label"), F.concat(F.lit("[ "), body, F.lit(" ]")).alias("text")), "label", "left"
    ).select(F.col("label").alias("_label"), F.coalesce("text", F.lit("[]")).alias("_text"))

    remaining = statements.join(
        in_place.where("size > 0").select(F.col("label").alias("_inlined")),
        (F.col("s") == F.col("_inlined")) & _is_bnode("s_kind"),
        "left_anti",
    )
    key = F.when(_is_bnode("o_kind"), F.col("o")).otherwise(
        F.concat(F.lit("<"), F.xxhash64(*STATEMENT_COLUMNS).cast("string"))
    )
    outer = remaining.withColumn("_key", key).join(written, F.col("_key") == F.col("_label"), "left")
    outer = outer.withColumn("_object", F.coalesce("_text", rendering.object_text(prefixes)))
    outer_entry = F.struct(
        rendering.predicate_text(prefixes, shorthand=True).alias("p"), F.col("_object").alias("o"), F.col("o").alias("k")
    )
    groups = (
        with_parts(outer, max_group, "_object")
        .groupBy("s_kind", "s", "part")
        .agg(F.sort_array(F.collect_set(outer_entry)).alias("entries"))
    )
    # Without a label a node has to be one block, so its block must hold all of its statements.
    anonymous = nodes.where(F.col("uses") == 0).select(F.col("label").alias("_anon"), "size")
    groups = groups.join(
        anonymous,
        (F.col("s") == F.col("_anon")) & (F.size("entries") == F.col("size")) & _is_bnode("s_kind"),
        "left",
    )
    text = predicate_lists(F.col("entries"), "p", "o", next_predicate=" ;\n    ", next_object=", ")
    subject = F.when(F.col("_anon").isNotNull(), "[]").otherwise(rendering.subject_text(prefixes))
    return groups.select("s_kind", "s", F.concat(subject, F.lit("\n    "), text, F.lit(" .")).alias("block"))
