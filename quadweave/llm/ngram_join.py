"""Exact Jaccard join of documents on word n-grams by vertical partitioning.

The global order of n-grams is: rare before frequent, then by hash. Sets are made from the texts again in every
pass; only sets that meet in step 4 are written. They are cut by that order where needed:

1. *Classes.* Documents with equal sets are one class; only classes are joined.
2. *Prefix fragment.* Two sets with similarity t share an n-gram among the first n - ceil(t n) + 1 of each, in any
   fixed order. Counts of all n-grams in hash-ordered prefixes say which are frequent; those go last.
3. *Short lists* of classes that share a prefix n-gram are counted per pair: partial overlaps of the prefix fragment.
   A pair that differs there more than a link may differ altogether goes. *Long lists* (near copies of one text)
   give no pairs.
4. Classes connected by remaining pairs or long lists are dealt to blocks and every two blocks of a group meet in one
   task. The rest of the order is cut into fragments of n-grams; each fragment's overlaps are counted separately, as
   products of 0/1 matrices, and summed per pair. A spanning forest of the links leaves the task. Blocks meet in
   turns, by their distance in the circle of a group's blocks: each turn moves a bounded share of all n-grams, and
   only its links are kept.
5. Connected components of the links.

No list, pair or candidate is dropped. Frequent n-grams are kept as a bitmap of fixed size; false positives only
change the order, which may be any. n-grams are 48-bit hashes; two different n-grams of one pair of documents
coincide with a chance of about n*m / 2**48.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.llm.common import bitmap, broadcast_if_small, components, in_bitmap, shared_table
from quadweave.llm.tokens import HASH_BITS, give_back, mixed, pieces

#: n-grams in more prefixes than this go last in the order.
FREQUENT = 16
#: Lists of at most this many classes give pairs, longer ones blocks.
LONG_LIST = 32
#: Classes in a block; a task compares two blocks.
BLOCK_CLASSES = 256
#: n-grams in a fragment (columns of a 0/1 matrix).
COLUMNS = 1024
#: Sets that meet in one turn may hold so many of all documents' n-grams, or two blocks of a group if they are more.
TURN_SHARE = 0.5


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8])
    offsets = (bounds * (HASH_BITS // 8)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // (HASH_BITS // 8), 8), dtype=np.uint8)
    out[:, : HASH_BITS // 8] = raw.reshape(-1, HASH_BITS // 8)
    return out.view("<u8").ravel()


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return _unpacked(raw), (offsets - offsets[0]) // (HASH_BITS // 8)


def _prefix_sizes(n: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    return np.where(n > 0, n - -(-n * numerator // denominator) + 1, 0)


class Shingled:
    """The sets of n-grams of a table's texts, made anew in every pass; the table must give the same rows each time."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int, lower: bool):
        self.docs, self.words, self.lower = docs.select(id_col, text_col), words, lower
        self.kind = docs.schema[id_col].dataType.simpleString()

    def over(self, function, schema: str) -> DataFrame:
        """function(ids, sig, n, values, bounds) -> arrays of the schema, over runs of rows.

        n: each set's size; sig: its 64-bit signature; values: the sets' hashes in order, cut by bounds.
        """
        words, lower = self.words, self.lower
        names = [x.split()[0] for x in schema.split(", ")]

        def run(batches):
            for batch in batches:
                for first, end, texts in pieces(batch.column(1)):
                    values, bounds = texts.shingles(words, lower)
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values ^ np.uint64(0x5BF03635F0A31D21)))])
                    n = np.diff(bounds)
                    sig = mixed(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(np.uint64)).view(np.int64)
                    ids = batch.column(0).slice(first, end - first)
                    yield pa.RecordBatch.from_arrays(function(ids, sig, n, values, bounds), names)
                give_back()

        return self.docs.mapInArrow(run, schema)

    def sizes(self) -> DataFrame:
        """(id, n, sig), a row per row of the table."""

        def run(ids, sig, n, values, bounds):
            return [ids, pa.array(n, pa.int64()), pa.array(sig)]

        return self.over(run, f"id {self.kind}, n bigint, sig bigint")

    def packed(self, wanted) -> DataFrame:
        """(id, n, sig, grams): sets, sorted and packed, whose signatures may be in the bitmap that was broadcast."""

        def run(ids, sig, n, values, bounds):
            kept = (n > 0) & in_bitmap(wanted.value, sig)
            values, n = values[np.repeat(kept, n)], n[kept]
            grams = _packed(values, np.concatenate([[0], np.cumsum(n)]))
            return [ids.filter(pa.array(kept)), pa.array(n, pa.int64()), pa.array(sig[kept]), grams]

        return self.over(run, f"id {self.kind}, n bigint, sig bigint, grams binary")


def _hash_prefixes(sets: Shingled, numerator: int, denominator: int) -> DataFrame:
    """n-grams of half as much again as each prefix in hash order: what may move up into the prefix counts as well."""

    def run(ids, sig, n, values, bounds):
        rank = np.arange(len(values)) - np.repeat(bounds[:-1], n)
        kept = values[rank < np.repeat(_prefix_sizes(n, numerator, denominator) * 3 // 2, n)]
        return [pa.array(kept.view(np.int64))]

    return sets.over(run, "gram bigint")


def _ordered_prefixes(sets: Shingled, numerator: int, denominator: int, frequent, copied) -> DataFrame:
    def run(ids, sig, n, values, bounds):
        late = in_bitmap(frequent.value, values).astype(np.uint64)
        row = np.repeat(np.arange(len(n), dtype=np.uint64), n)
        key = np.sort((row << np.uint64(HASH_BITS + 1)) | (late << np.uint64(HASH_BITS)) | values)
        rank = np.arange(len(values)) - np.repeat(bounds[:-1], n)
        kept = rank < np.repeat(_prefix_sizes(n, numerator, denominator), n)
        row = row[kept].astype(np.int64)
        return [  # the rank is the place in the order
            pa.array((key[kept] & np.uint64((1 << HASH_BITS) - 1)).view(np.int64)),
            pa.array(sig[row]),
            pa.array(n[row]),
            pa.array(rank[kept].astype(np.int32)),
            pa.array(in_bitmap(copied.value, sig)[row]),
        ]

    return sets.over(run, "gram bigint, sig bigint, n bigint, rank int, copied boolean")


def _block_links(numerator: int, denominator: int):
    def forest(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("sig").sort_values("sig", ignore_index=True)
        sets = [_unpacked(np.frombuffer(x, np.uint8)) for x in frame["grams"]]
        n = frame["n"].to_numpy()
        rows = np.repeat(np.arange(len(n)), n)
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        values, rows = values[order], rows[order]
        fresh = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
        column = np.cumsum(fresh) - 1
        shared = np.bincount(column) > 1 if len(column) else np.zeros(0, bool)
        keep = shared[column] if len(column) else shared
        column, rows = (np.cumsum(shared) - 1)[column[keep]], rows[keep]
        overlap = np.zeros((len(n), len(n)), dtype=np.float64)
        ends = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + COLUMNS + 1, COLUMNS))
        for f, (start, end) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            part = np.zeros((len(n), COLUMNS), dtype=np.float32)
            part[rows[start:end], column[start:end] - f * COLUMNS] = 1
            overlap += part @ part.T
        total = n[:, None] + n[None, :]
        linked = overlap * (numerator + denominator) >= numerator * total
        parent = np.arange(len(n))
        out = []

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i in range(len(n)):
            for j in np.flatnonzero(linked[i, i + 1 :]) + i + 1:
                a, b = root(i), root(j)
                if a != b:
                    parent[b] = a
                    out.append((i, j))
        sig = frame["sig"].to_numpy()
        give_back()
        i, j = np.array(out, dtype=np.int64).reshape(-1, 2).T
        return pd.DataFrame({"a": sig[i], "b": sig[j]})

    return forest


def _long_groups(lists: DataFrame) -> DataFrame:
    """(node, component): classes connected by lists of more than LONG_LIST classes."""
    lists = lists.filter(F.col("length") > LONG_LIST)
    heads = shared_table(lists.groupBy("gram").agg(F.min("sig").alias("b")), "heads")
    return components(lists.join(broadcast_if_small(heads), "gram").select(F.col("sig").alias("a"), "b"))


def _pairs(lists: DataFrame, groups: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(a, b): classes that meet in short lists, are in no common group and may link by their counts in the prefix.

    A link's sets differ in at most total - 2 ceil(numerator total / (numerator + denominator)) n-grams. Up to the end
    of the prefix that ends first, they share only what they meet in. That is the whole prefix of the one and, of the
    other, its n-grams up to the last shared one at least. (Classes that also meet in a long list, which isn't counted
    here, are in one group.)
    """
    pairs = (
        lists.filter(F.col("length") <= LONG_LIST)
        .groupBy("gram")
        .agg(F.array_sort(F.collect_list(F.struct("n", "sig", "rank"))).alias("m"))
        .select(
            F.explode(
                F.expr(
                    f"""flatten(transform(sequence(1, size(m)), i -> transform(
                    filter(slice(m, i + 1, size(m)), y -> y.n * {numerator} <= m[i - 1].n * {denominator}),
                    y -> struct(m[i - 1] as x, y as y))))"""
                )
            ).alias("p")
        )
        .groupBy(F.col("p.x.sig").alias("a"), F.col("p.y.sig").alias("b"), F.col("p.x.n").alias("na"), F.col("p.y.n").alias("nb"))
        .agg(F.max("p.x.rank").alias("ra"), F.max("p.y.rank").alias("rb"), F.count("*").alias("met"))
    )
    prefix = f"{{0}} - ceil({{0}} * {numerator} / {denominator}BD) + 1"
    apart = F.expr(f"least({prefix.format('na')} + rb + 1, {prefix.format('nb')} + ra + 1) - 2 * met")
    allowed = F.expr(f"na + nb - 2 * ceil({numerator} * (na + nb) / {numerator + denominator}BD)")
    return (
        pairs.filter(apart <= allowed)
        .join(groups.select(F.col("node").alias("a"), F.col("component").alias("ga")), "a", "left")
        .join(groups.select(F.col("node").alias("b"), F.col("component").alias("gb")), "b", "left")
        .filter("ga IS NULL OR gb IS NULL OR ga <> gb")
        .select("a", "b")
    )


def _dealt(members: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(component, band, sig, n, blocks, block): the blocks of each group's classes, without groups of one."""
    # large groups are cut by size of set: sizes of linked sets differ by one band at most, so each goes to two
    large = members.groupBy("component").count().filter(F.col("count") > BLOCK_CLASSES).select("component", F.lit(True).alias("large"))
    band = F.floor(F.log("n") / math.log(denominator / numerator) + 1e-9).cast("int")
    units = members.join(large, "component", "left").withColumns({"own": F.when(F.col("large"), band).otherwise(0)})
    units = units.withColumn("band", F.explode(F.when(F.col("large"), F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))
    # classes of the band below meet in their own band
    sizes = units.groupBy("component", "band").agg(F.count("*").alias("n_unit"), F.max(F.expr("own = band")).alias("owned"))
    return (
        units.join(sizes.filter("n_unit > 1 AND owned"), ["component", "band"])
        .withColumn("blocks", F.ceil(F.col("n_unit") / BLOCK_CLASSES).cast("int"))
        .select("component", "band", "sig", "n", "blocks", F.expr("cast(pmod(xxhash64(sig), blocks) as int)").alias("block"))
    )


def _turns(grams: dict[int, int], most: float) -> list[tuple[int, int, int, int]]:
    """(first, last, part, parts): distances of blocks that meet in one turn, and which part of the pairs at that distance.

    grams: n-grams of the sets in groups of so many blocks. A turn moves at most `most` n-grams, as far as the pairs
    can be told apart: every two blocks of a group meet at one distance up to half of their number.
    """
    turns, first, moved = [], 0, 0
    for distance in range(max(grams, default=0) // 2 + 1):
        here = sum(g * (1 if distance in (0, b / 2) else 2) for b, g in grams.items() if distance <= b // 2)
        if moved and moved + here > most:
            turns.append((first, distance - 1, 0, 1))
            first, moved = distance, 0
        if here > most:
            parts = math.ceil(here / most)
            turns += [(distance, distance, part, parts) for part in range(parts)]
            first, moved = distance + 1, 0
        else:
            moved += here
    return [*turns, (first, max(grams) // 2, 0, 1)] if moved else turns


def _meetings(sets: DataFrame, dealt: DataFrame, first: int, last: int, part: int, parts: int) -> DataFrame:
    """The sets of one turn, a row for each pair (i, i + distance) of blocks that a set's block is in."""
    found = sets.join(broadcast_if_small(dealt.filter(f"{first} <= blocks div 2")), "sig")
    found = found.withColumn("distance", F.explode(F.expr(f"sequence({first}, cast(least({last}, blocks div 2) as int))")))
    here, there = F.col("block"), F.expr("pmod(block - distance, blocks)")
    opposite = F.col("distance") * 2 == F.col("blocks")  # i and i + distance are one pair with i + distance and i
    either = F.when(opposite, F.array(F.least(here, there))).otherwise(F.array_distinct(F.array(here, there)))
    found = found.withColumn("i", F.explode(either))
    if parts > 1:
        found = found.filter(F.pmod(F.xxhash64("component", "band", "i"), F.lit(parts)) == part)
    return found.select("component", "band", "i", "distance", "sig", "n", "grams")


def _links(sets: Shingled, classes: DataFrame, lists: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links (a, b) between classes, as spanning forests of blocks."""
    spark = classes.sparkSession
    long = shared_table(_long_groups(lists), "long")
    edges = _pairs(lists, long, numerator, denominator).union(long.select("node", "component"))
    groups = components(edges)
    members = shared_table(
        groups.withColumnRenamed("node", "sig").join(classes.select("sig", "least", "n"), "sig"), "members"
    )
    dealt = shared_table(_dealt(members, numerator, denominator), "dealt")
    wanted = spark.sparkContext.broadcast(bitmap(members, "sig"))
    found, held = sets.packed(wanted), members.select(F.col("sig").alias("_sig"), "least")
    found = shared_table(
        found.join(broadcast_if_small(held), (F.col("sig") == F.col("_sig")) & F.col("id").eqNullSafe(F.col("least"))).select("sig", "grams"),
        "sets",
    )
    grams = {r.blocks: r.grams for r in dealt.groupBy("blocks").agg(F.sum("n").alias("grams")).collect()}
    most = TURN_SHARE * (classes.agg(F.sum(F.col("n") * F.col("copies"))).first()[0] or 0)
    links = classes.select(F.col("sig").alias("a"), F.col("sig").alias("b")).limit(0)
    for turn in _turns(grams, most):
        met = _meetings(found, dealt, *turn).groupBy("component", "band", "i", "distance")
        links = links.union(shared_table(met.applyInPandas(_block_links(numerator, denominator), "a bigint, b bigint"), "met"))
    return links


def ngram_components(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    similarity: tuple[int, int] = (4, 5),
    lower: bool = True,
) -> DataFrame:
    """One row per document: id, n_shingles, class_id, component_id.

    Two documents link when the Jaccard similarity of their sets of word n-grams is at least the fraction
    ``similarity``; component_id is the least id that links reach. class_id tells equal sets. Texts with fewer
    words than an n-gram are one n-gram; a text without words (or null) links with nothing, its component_id
    is its own id and its class_id is null. Repeated rows come back as often as they came. A null id never
    stands for a component unless all its ids are null. Other columns are ignored. An empty table gives no rows.
    The table is read four times and must give the same rows each time.
    """
    numerator, denominator = similarity
    spark = docs.sparkSession
    sets = Shingled(docs, id_col, text_col, words, lower)
    sizes = shared_table(sets.sizes(), "sizes")
    classes = shared_table(
        sizes.filter("n > 0").groupBy("sig").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.count("*").alias("copies")), "classes"
    )
    counts = _hash_prefixes(sets, numerator, denominator).groupBy("gram").count().filter(F.col("count") > FREQUENT)
    frequent = spark.sparkContext.broadcast(bitmap(counts, "gram"))
    copied = spark.sparkContext.broadcast(bitmap(classes.filter("copies > 1"), "sig"))
    entries = _ordered_prefixes(sets, numerator, denominator, frequent, copied)
    entries = entries.filter("not copied").union(entries.filter("copied").distinct()).drop("copied")
    # counted apart and joined: counting merges a frequent n-gram's rows before the shuffle, the join splits them
    entries = shared_table(entries, "entries")
    lengths = entries.groupBy("gram").agg(F.count("*").alias("length")).filter("length > 1")
    lists = shared_table(entries.join(lengths, "gram"), "lists")
    reached = components(_links(sets, classes, lists, numerator, denominator))
    joined = classes.join(reached, classes["sig"] == reached["node"]).select("sig", "least", "component")
    named = joined.join(joined.groupBy("component").agg(F.min("least").alias("head")), "component").select("sig", "head")
    ids = classes.join(named, "sig", "left").select(
        F.col("sig").alias("class_id"), F.coalesce("head", "least").alias("component_id")
    )
    rows = sizes.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sig")).alias("class_id")
    )
    return rows.join(ids, "class_id", "left").select(
        id_col,
        "n_shingles",
        "class_id",
        F.when(F.col("n_shingles") == 0, F.col(id_col)).otherwise(F.col("component_id")).alias("component_id"),
    )
