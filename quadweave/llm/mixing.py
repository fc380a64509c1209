"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are put in a shuffled order (by hash) and cut into blocks of equally many words. Slot k
of the mix has the point frac(k * golden ratio) in [0, 1); the cumulative weights of the sources' slots say whose
it is. The r-th slot of a source takes its block r modulo its blocks, so a source larger than its target is taken in
part and a smaller one repeatedly. The points spread evenly, so every stretch of the mix is mixed as the whole.
Slots that a source still misses at the end (a few, by the discrepancy of the points) are appended, those it has too
many are left empty, and its last block is cut to the word.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadweave.llm.common import shared_table

GOLDEN = 0.6180339887498949
#: Slots that are ranked together.
SLOT_CHUNK = 1 << 16
#: Documents of a source whose places are summed together, about.
LANE_ROWS = 2_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than space and 0x09 to 0x0D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: Sequence[int], weights: Sequence[float], most: float) -> list[float]:
    """Shares of sum(sizes) by weight; none above most times its size, the excess reshared until none is."""
    total, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        weight = sum(weights[i] for i in sorted(open_))
        if weight <= 0:
            break
        for i in sorted(open_):
            out[i] = left * weights[i] / weight
        above = {i for i in open_ if out[i] > most * sizes[i]}
        if not above:
            break
        for i in above:
            out[i] = float(most * sizes[i])
        open_ -= above
    return out


def _schedule(spark: SparkSession, needs: Sequence[int]) -> DataFrame:
    """(slot, s, rank) with ranks 0 to needs[s] - 1 of every source s."""
    total = sum(needs)
    edges = np.cumsum(needs) / max(1, total)

    @F.pandas_udf("int")
    def source_of(point: pd.Series) -> pd.Series:
        at = np.searchsorted(edges, point.to_numpy(), side="right")
        return pd.Series(np.minimum(at, len(edges) - 1).astype(np.int32))

    slots = spark.range(total).withColumn("point", (F.col("id") + 1) * F.lit(GOLDEN))
    slots = slots.select(
        F.col("id").alias("slot"),
        F.floor(F.col("id") / SLOT_CHUNK).alias("chunk"),
        source_of(F.col("point") - F.floor("point")).alias("s"),
    )
    chunks = slots.groupBy("s", "chunk").count()
    before = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("s", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    ranked = slots.join(chunks, ["s", "chunk"]).select(
        "slot",
        "s",
        (F.col("offset") + F.row_number().over(Window.partitionBy("chunk", "s").orderBy("slot")) - 1).alias("rank"),
    )
    need = spark.createDataFrame([(i, int(n)) for i, n in enumerate(needs)], "s int, need bigint")
    have = slots.groupBy("s").count()
    missing = (
        need.join(have, "s", "left")
        .withColumn("have", F.coalesce("count", F.lit(0)))
        .filter("have < need")
        .withColumn("rank", F.explode(F.expr("sequence(have, need - 1)")))
        .select((F.lit(total) + F.col("rank")).alias("slot"), "s", "rank")
    )
    return ranked.join(F.broadcast(need), "s").filter("rank < need").select("slot", "s", "rank").union(missing)


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str = "size",
    pattern: Sequence[float] = (1, 2, 3),
    most: int = 3,
    block_words: int = 4096,
    most_sources: int = 100_000,
    seed: int = 11,
) -> tuple[DataFrame, DataFrame]:
    """The mix of rows (id, source, size in words), as pieces and as totals.

    Pieces: slot, id, source, copy, size, first_word, words. Totals: one row per row of docs with id, source, copy,
    size, source_size, target, taken. Sources in code-point order (null last) weigh pattern, repeating; targets share
    the sum of all sizes and stop at ``most`` times the source's size. Each source's taken words are its target,
    rounded; no row gives more than ``most`` times its words. Rows that are equal in all three columns are numbered by
    copy. Rows of size 0 take no part. The outcome depends on the rows and the seed only, not on their order.
    One number per source comes to the driver; more than ``most_sources`` sources are an error.
    """
    spark = docs.sparkSession
    rows = shared_table(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(size_col).cast("bigint").alias("size")),
        "sizes",
    )
    sums = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    found = sums.orderBy(F.col("source").asc_nulls_last()).limit(most_sources + 1).collect()
    if len(found) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    sizes = [int(x["size"]) for x in found]
    goals = targets(sizes, [pattern[i % len(pattern)] for i in range(len(found))], most)
    quotas = [min(most * size, int(goal + 0.5)) for size, goal in zip(sizes, goals, strict=True)]
    blocks = [-(-size // block_words) for size in sizes]
    needs = [
        (quota // size) * n + -(-(quota % size) // block_words) if size else 0
        for quota, size, n in zip(quotas, sizes, blocks, strict=True)
    ]
    lanes = [max(1, int(x["rows"]) // LANE_ROWS) for x in found]
    table = spark.createDataFrame(
        [
            (i, x["source"], *v)
            for i, (x, *v) in enumerate(zip(found, sizes, goals, quotas, blocks, needs, lanes, strict=True))
        ],
        f"s int, source {rows.schema['source'].dataType.simpleString()}, source_size bigint, target double, "
        "quota bigint, blocks bigint, needs bigint, lanes int",
    )
    copies = (
        rows.groupBy("id", "source", "size")
        .count()
        .withColumn("copy", F.explode(F.expr("sequence(1, cast(count as int))")))
        .join(F.broadcast(table.select("s", F.col("source").alias("name"), "lanes")), F.col("source").eqNullSafe(F.col("name")))
        .withColumn("key", F.xxhash64("id", "copy", "size", F.lit(seed)))
        .withColumn("lane", F.pmod("key", "lanes"))
        .select("id", "s", "size", "copy", "key", "lane")
    )
    lanes_before = Window.partitionBy("s").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        copies.groupBy("s", "lane")
        .agg(F.sum("size").alias("words"))
        .select("s", "lane", F.coalesce(F.sum("words").over(lanes_before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("s", "lane").orderBy("key", "id", "size", "copy").rowsBetween(Window.unboundedPreceding, 0)
    placed = copies.join(offsets, ["s", "lane"]).withColumn(
        "start", F.col("offset") + F.sum("size").over(within) - F.col("size")
    )
    cut = placed.select(
        "id",
        "s",
        "size",
        "copy",
        "start",
        F.explode_outer(
            F.when(
                F.col("size") > 0,
                F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)),
            )
        ).alias("block"),
    )
    # the epoch in which a source's quota ends, and where in it
    slots = (
        _schedule(spark, needs)
        .join(F.broadcast(table.select("s", "source_size", "quota", "blocks")), "s")
        .select(
            "s",
            "slot",
            F.expr("rank % blocks").alias("block"),
            F.expr("CASE WHEN rank div blocks < quota div source_size THEN source_size ELSE quota % source_size END").alias("until"),
        )
    )
    low = F.greatest("start", F.col("block") * block_words)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words, "until")
    pieces = cut.join(slots, ["s", "block"], "left").select(
        "s",
        "id",
        "copy",
        "size",
        "slot",
        (low - F.col("start")).alias("first_word"),
        F.greatest(F.coalesce(high - low, F.lit(0)), F.lit(0)).alias("words"),
    )
    small = F.broadcast(table.select("s", "source", "source_size", "target"))
    totals = (
        pieces.groupBy("s", "id", "copy", "size")
        .agg(F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("words"))), F.lit(0)).alias("taken"))
        .join(small, "s")
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "copy", "size", "source_size", "target", "taken")
    )
    pieces = (
        pieces.filter("slot is not null and words > 0")
        .join(small, "s")
        .select("slot", F.col("id").alias(id_col), F.col("source").alias(source_col), "copy", "size", "first_word", "words")
    )
    return pieces, totals
