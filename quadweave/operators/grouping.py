"""Subject grouping: the aggregation behind every grouped sink.

A hub subject may own a large part of all statements, so a group is never assumed to be small. A
first, map-side combined count finds subjects above ``max_group`` statements or ``MAX_GROUP_BYTES`` of
text; only those are cut into parts by a hash of their statements. Each part is a group of its own, which all grouped formats
allow. What is broadcast for this has at most ``HASH_CLASSES`` rows, whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.operators import rendering

HASH_CLASSES = 1 << 18
MAX_GROUP = 100_000
MAX_GROUP_BYTES = 64 << 20


def with_parts(statements: DataFrame, max_group: int | None = MAX_GROUP, object_text: str = "o") -> DataFrame:
    """Add ``part``: 0 for ordinary subjects, a hash bucket for the statements of large ones.

    ``None`` leaves out the count. It is for callers who know that every subject is small, say because
    each comes from one row of a table. ``object_text`` is the column that holds what is written for the object.
    """
    if max_group is None:
        return statements.withColumn("part", F.lit(0))
    hash_class = F.pmod(F.xxhash64("g", "s"), F.lit(HASH_CLASSES))
    sizes = statements.groupBy("g", "s").agg(
        F.greatest(
            F.count(F.lit(1)) / max_group, F.sum(F.octet_length(object_text) + F.octet_length("p")) / MAX_GROUP_BYTES
        ).alias("_n")
    )
    large = (
        sizes.where("_n > 1")
        .groupBy(hash_class.alias("_class"))
        .agg(F.ceil(F.max("_n")).cast("int").alias("_parts"))
    )
    statement_hash = F.xxhash64("p", "o_kind", "o", "o_dt", "o_lang")
    part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(statement_hash, F.col("_parts")).cast("int"))
    return (
        statements.withColumn("_class", hash_class)
        .join(F.broadcast(large), "_class", "left")
        .withColumn("part", part)
        .drop("_class", "_parts")
    )


def subject_groups(
    statements: DataFrame,
    entry: Column,
    max_group: int | None = MAX_GROUP,
    watch: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per (graph, subject, part) with its distinct ``entry`` values, sorted.

    Copies disappear inside the aggregation, so grouping and duplicate removal share one shuffle.
    ``watch`` sees every statement once, before copies are dropped.
    """
    parted = with_parts(statements, max_group)
    return (
        (watch(parted) if watch else parted)
        .groupBy("g", "s_kind", "s", "part")
        .agg(F.sort_array(F.collect_set(entry)).alias("entries"))
    )


def predicate_lists(entries: Column, predicate: str, obj: str, *, next_predicate: str, next_object: str) -> Column:
    """Render sorted (predicate, object) entries, naming each predicate once."""

    def piece(item: Column, index: Column) -> Column:
        before = F.get(entries, index - 1)
        separator = (
            F.when(index == 0, F.concat(item[predicate], F.lit(" ")))
            .when(before[predicate] == item[predicate], F.lit(next_object))
            .otherwise(F.concat(F.lit(next_predicate), item[predicate], F.lit(" ")))
        )
        return F.concat(separator, item[obj])

    return F.array_join(F.transform(entries, piece), "")


def turtle_blocks(
    statements: DataFrame,
    prefixes: Mapping[str, str] | None = None,
    max_group: int | None = MAX_GROUP,
    watch: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Turtle blocks as (g, s_kind, s, n, block): predicates and objects sorted by code point."""
    entry = F.struct(
        rendering.predicate_text(prefixes, shorthand=True).alias("p"), rendering.object_text(prefixes).alias("o")
    )
    groups = subject_groups(statements, entry, max_group, watch)
    text = predicate_lists(F.col("entries"), "p", "o", next_predicate=" ;\n    ", next_object=", ")
    block = F.concat(rendering.subject_text(prefixes), F.lit("\n    "), text, F.lit(" ."))
    return groups.select("g", "s_kind", "s", F.size("entries").alias("n"), block.alias("block"))


def trig_blocks(
    statements: DataFrame,
    prefixes: Mapping[str, str] | None = None,
    max_group: int | None = MAX_GROUP,
    watch: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Turtle blocks wrapped in their graph."""
    blocks = turtle_blocks(statements, prefixes, max_group, watch)
    named = F.concat(rendering.graph_text(prefixes), F.lit(" {\n"), F.col("block"), F.lit("\n}"))
    return blocks.withColumn("block", F.when(F.col("g").isNull(), F.col("block")).otherwise(named))
