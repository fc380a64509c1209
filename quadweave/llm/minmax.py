"""Near-duplicates by min-max hashing: both the least and the greatest value under each permutation make the signature.

1. *Sets.* Word shingles of every text, hashed, sorted and packed; documents with equal sets (equal 128-bit sums of two
   hashes) are one class, and only classes are compared.
2. *Signatures.* A permutation of the hashes gives two values of a set, its minimum and its maximum, so half as many
   evaluations make as many values. Two sets agree in each with a chance of their Jaccard similarity; as minimum and
   maximum of one permutation are not both the shared part's by luck alone, the share of agreeing values varies less.
3. *Banding.* ``rows`` minima of different permutations make a band, and so do their maxima. Classes that agree in a band
   share a bucket. Pairs of similarity t never meet with a chance of (1 - t**rows) ** (2 * permutations / rows): 5e-8
   for t = 0.8, 64 permutations and rows of 4.
4. *Confirmation* of pairs on full sets, one set of a pair held, the other one streamed by:
   every class with the first class of its buckets; then, only where that didn't connect them already, with the first of
   each bucket and with all of short buckets; and last, in long buckets that are still not connected, block by block.
5. *Connected components* of confirmed links.

No bucket is cut or dropped, and a long bucket gives no pairs: it gives links to one class, or blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.llm.common import broadcast_if_small, components, shared_table
from quadweave.llm.ngram_join import _block_links as block_links
from quadweave.llm.ngram_join import _packed as packed
from quadweave.llm.ngram_join import _sets as unpacked_sets
from quadweave.llm.tokens import give_back, mixed, pieces

#: Classes of a bucket up to this many meet pair by pair.
SHORT_BUCKET = 8
#: Classes that are compared with one copy of a set.
PARTNERS = 512
#: Classes in a block of a long bucket.
BLOCK_CLASSES = 512
_SEED = 0x5EED


def missed(similarity: float, permutations: int, rows: int) -> float:
    """The chance that two sets of that similarity share no bucket."""
    return (1 - similarity**rows) ** (2 * (permutations // rows))


def min_max_bands(values: np.ndarray, bounds: np.ndarray, permutations: int, rows: int) -> np.ndarray:
    """Bands (sets x 2 * permutations / rows) of non-empty sets of hashes: of their minima, then of their maxima."""
    rng = np.random.default_rng(_SEED)
    factors = rng.integers(0, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    terms = rng.integers(0, 1 << 63, permutations, dtype=np.uint64)
    spread = mixed(values.copy())
    count = permutations // rows
    out = np.zeros((len(bounds) - 1, 2 * count), dtype=np.uint64)
    for i in range(count * rows):
        permuted = spread * factors[i] + terms[i]
        for kind, least in enumerate((np.minimum.reduceat(permuted, bounds[:-1]), np.maximum.reduceat(permuted, bounds[:-1]))):
            at = kind * count + i // rows
            out[:, at] = mixed(out[:, at] * np.uint64(3) + least + np.uint64(at + 1))
    return out


def signed_sets(docs: DataFrame, id_col: str, text_col: str, words: int, permutations: int, rows: int) -> DataFrame:
    """(row, id, n, low, high, bands, grams): a number for the row, the set's size, sums of two hashes, bands, packed hashes."""

    def run(batches):
        for batch in batches:
            for first, end, texts in pieces(batch.column(1)):
                values, bounds = texts.shingles(words, lower=True)
                n = np.diff(bounds)
                keys = []
                for seed in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values ^ np.uint64(seed)))])
                    keys.append(pa.array(mixed(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(np.uint64)).view(np.int64)))
                full = np.flatnonzero(n)
                bands = min_max_bands(values, np.append(bounds[:-1][full], len(values)), permutations, rows) if len(full) else np.zeros((0, 1), np.uint64)
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands.shape[1], 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.array(n, pa.int64()),
                        *keys,
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel().view(np.int64))),
                        packed(values, bounds),
                    ],
                    ["id", "n", "low", "high", "bands", "grams"],
                )
            give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n bigint, low bigint, high bigint, bands array<bigint>, grams binary"
    return docs.select(id_col, text_col).mapInArrow(run, schema).select(F.monotonically_increasing_id().alias("row"), "*")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of rows whose full sets have that Jaccard similarity.

    The rows of one `a` come after its own set, in tasks of PARTNERS of them, so a task holds one set and a batch.
    """
    numerator, denominator = similarity
    counts = pairs.groupBy("a").agg(F.count("*").alias("partners"))
    dealt = shared_table(
        pairs.join(counts, "a").select("a", "b", F.expr(f"cast(pmod(xxhash64(b), 1 + partners div {PARTNERS}) as int)").alias("share")),
        "pairs",
    )
    grams = sets.select("row", "grams")
    held = broadcast_if_small(dealt.select("a", "share").distinct())
    held = grams.join(held, F.col("row") == F.col("a")).select("a", "share", F.lit(0).alias("kind"), F.col("a").alias("b"), "grams")
    streamed = grams.join(broadcast_if_small(dealt), F.col("row") == F.col("b")).select("a", "share", F.lit(1).alias("kind"), "b", "grams")

    def run(batches):
        mine = np.zeros(0, np.uint64)
        for batch in batches:
            values, bounds = unpacked_sets(batch.column(4))
            kind, a, b = (batch.column(i).to_numpy() for i in (2, 0, 3))
            linked = np.zeros(len(a), dtype=bool)
            for i in range(len(a)):
                other = values[bounds[i] : bounds[i + 1]]
                if kind[i] == 0:
                    mine = other
                    continue
                at = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
                both = int((mine[at] == other).sum())
                linked[i] = both * denominator >= numerator * (len(mine) + len(other) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b[linked])], ["a", "b"])
            give_back()

    rows = held.union(streamed).repartition("a", "share").sortWithinPartitions("a", "share", "kind")
    return shared_table(rows.mapInArrow(run, "a bigint, b bigint"), "links")


def _apart(pairs: DataFrame, reached: DataFrame) -> DataFrame:
    """Pairs (a, b) that no chain of links connects yet."""
    here = broadcast_if_small(reached)
    return (
        pairs.join(here.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        .join(here.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        .filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        .select("a", "b")
    )


def _blocks(members: DataFrame, reached: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame | None:
    """Links within long buckets whose classes are not all connected, if there are such buckets.

    Each two blocks of a bucket meet in one task, but for two of its largest component.
    """
    placed = members.join(broadcast_if_small(reached), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    open_ones = (
        placed.groupBy("bucket", "component")
        .agg(F.count("*").alias("here"), F.bit_xor(F.xxhash64("node")).alias("whose"))
        .groupBy("bucket")
        .agg(F.sum("here").alias("size"), F.max(F.struct("here", "component")).alias("main"), F.bit_xor("whose").alias("whose"))
        .filter("main.here < size")
        .groupBy("whose", "size")  # buckets of the same classes count once
        .agg(F.min(F.struct("bucket", "main")).alias("first"))
        .select("first.bucket", "size", F.col("first.main.component").alias("main"), F.col("first.main.here").alias("most"))
    )
    # classes of the bucket's largest component meet the others only
    dealt = shared_table(
        placed.join(open_ones, "bucket")
        .withColumns(
            {
                "rest": F.expr(f"cast(ceil((size - most) / {BLOCK_CLASSES}) as int)"),
                "large": F.expr(f"cast(ceil(most / {BLOCK_CLASSES}) as int)"),
            }
        )
        .withColumn("block", F.expr("cast(if(component = main, rest + pmod(xxhash64(node), large), pmod(xxhash64(node), rest)) as int)"))
        .select("bucket", "node", "block", F.expr("if(component = main, rest, rest + large)").alias("others")),
        "dealt",
    )
    if dealt.isEmpty():
        return None
    blocks = (
        sets.select("row", "n", "grams")
        .join(broadcast_if_small(dealt), F.col("row") == F.col("node"))
        .withColumn("other", F.explode(F.expr("sequence(0, others - 1)")))
        .select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("row").alias("sig"), "n", "grams")
    )
    return shared_table(blocks.groupBy("bucket", "i", "j").applyInPandas(block_links(*similarity), "a bigint, b bigint"), "block-links")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 2,
    similarity: tuple[int, int] = (4, 5),
    permutations: int = 64,
    rows: int = 4,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Documents link when the Jaccard similarity of their sets of word shingles (A-Z lower-cased) is at least the fraction
    ``similarity``, which is confirmed on full sets; component_id is the least id that links reach, and kept says that it is
    the document's own. See ``missed`` for the chance that a pair isn't looked at. Texts with fewer words than a shingle
    are one shingle; a text without words (or null) links with nothing, and its component_id is its own id.

    Repeated rows come back as often as they came, and all rows of a kept id are kept. A null id stands for a component only
    if all its ids are null; kept compares nulls as equal. Other columns are ignored. An empty table gives no rows.
    """
    numerator, denominator = similarity
    sets = shared_table(signed_sets(docs, id_col, text_col, words, permutations, rows), "sets")
    full = sets.filter("n > 0")
    classes = shared_table(
        full.groupBy("low", "high", "n").agg(F.min("row").alias("node"), F.min("id").alias("least")), "classes"
    )
    firsts = broadcast_if_small(classes.select("node"))
    entries = full.select("row", "n", "bands").join(firsts, F.col("row") == F.col("node")).select("node", "n", F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("first")).filter("size > 1")
    members = shared_table(entries.join(buckets, "bucket").select("bucket", "size", "node", "n", F.col("first.node").alias("first"), F.col("first.n").alias("first_n")), "members")
    alike = f"{{0}} * {denominator} >= {{1}} * {numerator} AND {{1}} * {denominator} >= {{0}} * {numerator}"

    stars = members.filter("first <> node AND " + alike.format("n", "first_n")).select(F.col("first").alias("a"), F.col("node").alias("b"))
    once = shared_table(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "once")
    links = confirmed(once, sets, similarity)
    reached = shared_table(components(links), "reached")

    short = (
        members.filter(F.col("size") <= SHORT_BUCKET)
        .groupBy("bucket")
        .agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("m"))
        .select(F.explode(F.expr(
            f"""flatten(transform(sequence(1, size(m)), i -> transform(
            filter(slice(m, i + 1, size(m)), y -> {alike.format("y.n", "m[i - 1].n")}), y -> struct(m[i - 1].node as a, y.node as b))))"""
        )).alias("p"))
        .select("p.a", "p.b")
    )
    more = _apart(stars.union(short).distinct(), reached).join(broadcast_if_small(once), ["a", "b"], "left_anti")
    more = shared_table(more, "more")
    if not more.isEmpty():
        links = links.union(confirmed(more, sets, similarity))
        reached = shared_table(components(links), "reached")

    further = _blocks(members.filter(F.col("size") > SHORT_BUCKET), reached, sets, similarity)
    if further is not None:
        reached = components(links.union(further))
    placed = classes.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = placed.groupBy("component").agg(F.min("least").alias("head"))
    named = placed.join(heads, "component").select("low", "high", "n", "head")
    found = sets.select("id", "n", "low", "high").join(named, ["low", "high", "n"], "left")
    head = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("head"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), head.alias("component_id"), F.col("id").eqNullSafe(head).alias("kept"))
