"""Merkle fingerprints of documents: sections, paragraphs and sentence-sized leaves, in DataFrame functions only.

A text is cut after blank lines into sections, these after line ends into paragraphs, these after sentence ends or
LEAF characters into leaves; nothing is left out, so the pieces make up the text. Leaves are hashed, paragraphs,
sections and the root are hashes of the hashes below. A fingerprint is the root and the tree of leaf hashes: roots
test equality, and unequal branches say where texts differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.llm.common import broadcast_if_small, shared_table

LEAF = 160
SECTION_CUT = r"(?<=\n\n)(?=[^\n])"
PARAGRAPH_CUT = r"(?<=\n)"
LEAF_PATTERN = rf"(?s)(?:.{{1,{LEAF}}}?(?:[.!?]\s+|$)|.{{{LEAF}}})"
#: Hexadecimal digits of a leaf's hash.
DIGITS = 16


def tree(text: Column) -> Column:
    """array<array<array<string>>>: leaf hashes by section and paragraph; null is an empty text and has none."""

    def cut(x: Column, pattern: str) -> Column:
        return F.filter(F.split(x, pattern), lambda y: y != "")

    def cut_leaves(paragraph: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(paragraph, F.lit(LEAF_PATTERN), F.lit(0)), lambda x: F.left(F.sha2(x, 256), F.lit(DIGITS))
        )

    text = F.coalesce(text, F.lit(""))
    return F.transform(cut(text, SECTION_CUT), lambda s: F.transform(cut(s, PARAGRAPH_CUT), cut_leaves))


def root(nodes: Column) -> Column:
    def paragraph(x: Column) -> Column:
        return F.sha2(F.array_join(x, ","), 256)

    def section(x: Column) -> Column:
        return F.sha2(F.array_join(F.transform(x, paragraph), ";"), 256)

    return F.sha2(F.array_join(F.transform(nodes, section), "|"), 256)


def fingerprint(nodes: Column) -> Column:
    """root:leaf,leaf;leaf|leaf... with commas between leaves, semicolons between paragraphs, bars between sections."""
    inner = F.transform(nodes, lambda s: F.array_join(F.transform(s, lambda p: F.array_join(p, ",")), ";"))
    return F.concat(root(nodes), F.lit(":"), F.array_join(inner, "|"))


def leaves(nodes: Column) -> Column:
    """Numbers that stand for the leaves of a tree."""
    return F.transform(F.flatten(F.flatten(nodes)), lambda x: F.xxhash64(x))


def likeness(a: Column, b: Column) -> Column:
    """Shared share of the distinct leaves of two trees, 0 to 1; two empty trees are alike."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def differing_sections(a: Column, b: Column) -> Column:
    """Numbers, from 0, of the sections of tree a that are not, whole, in tree b."""
    return F.filter(
        F.transform(a, lambda s, i: F.when(~F.array_contains(b, s), i)), lambda i: i.isNotNull()
    )


def neighbours(rows: DataFrame, order: list[str]) -> DataFrame:
    """Distinct rows of order columns with those of the next row (next_...) and of the one before (previous_...).

    Order is descending, nulls last; after the last row comes the first. Rows are sorted over all tasks and numbered by
    task and place; the next row is found by an equality join on that number, so no task sees more than its part.
    """
    by = [F.col(c).desc_nulls_last() for c in order]
    number = F.monotonically_increasing_id()
    placed = shared_table(rows.select(order).distinct().orderBy(*by).withColumn("at", number), "order")
    part = F.shiftright("at", 33)
    # the first row of each task follows the last row of the one before
    edges = placed.groupBy(part.alias("part")).agg(F.min("at").alias("first"), F.max("at").alias("last")).collect()
    edges = sorted((x["part"], x["first"], x["last"]) for x in edges)
    pairs = [(x[2], y[1]) for x, y in zip(edges, edges[1:] + edges[:1], strict=True)]
    jumps = F.broadcast(rows.sparkSession.createDataFrame(pairs, "at bigint, jump bigint"))
    linked = placed.join(jumps, "at", "left").withColumn("to", F.coalesce("jump", F.col("at") + 1)).drop("jump")
    after = placed.select(F.col("at").alias("to"), *(F.col(c).alias(f"next_{c}") for c in order))
    return linked.join(after, "to").drop("at", "to")


def _key(column: str) -> list[Column]:
    return [F.coalesce(F.col(column), F.lit(0)).alias("_id"), F.col(column).isNull().alias("_null")]


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of the text (floor of its code points) replaced by as many of the next document,
    or all. Documents follow each other by descending id, nulls last, then by a hash of the text; after the last comes
    the first. Rows that are equal in id and text are one document in that order and give equal results. A null text is
    empty. Other columns are ignored; an empty table gives no rows; a single document follows itself. Ids are integers.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), F.length(text).alias("n"), text.alias("text"))
    order = shared_table(neighbours(rows, ["id", "hash", "n"]), "next")
    # what each document sends to the one before it: where to, and how many characters
    back = broadcast_if_small(
        order.select(
            F.col("next_id").alias("id"),
            F.col("next_hash").alias("hash"),
            F.col("id").alias("to_id"),
            F.col("hash").alias("to_hash"),
            F.floor(F.col("n") / 3).cast("int").alias("k"),
        )
    )
    same = rows["id"].eqNullSafe(back["id"]) & (rows["hash"] == back["hash"])
    # ids that may be null are compared as two columns, so that removing repeated rows and joining share a shuffle
    sent = (
        rows.join(back, same)
        .select(
            *_key("to_id"),
            F.col("to_hash").alias("hash"),
            F.substring("text", F.lit(1), F.col("k")).alias("head"),
            leaves(tree(F.col("text"))).alias("next_leaves"),
        )
        .dropDuplicates(["_id", "_null", "hash"])
    )
    k = F.floor(F.col("n") / 3).cast("int")
    joined = rows.select("*", *_key("id")).join(sent, ["_id", "_null", "hash"]).select(
        "id",
        "n",
        F.concat(F.substring("text", F.lit(1), F.col("n") - k), "head").alias("edited"),
        tree(F.col("text")).alias("own"),
        "next_leaves",
    )
    grown = joined.withColumn("edited_tree", tree(F.col("edited")))
    return grown.select(
        F.col("id").alias(id_col),
        F.col("n").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(leaves(F.col("own")), leaves(F.col("edited_tree"))).alias("near_edited"),
        likeness(leaves(F.col("own")), F.col("next_leaves")).alias("near_next"),
    )
