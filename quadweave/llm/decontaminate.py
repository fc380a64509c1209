"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over neighbouring words; the words under its gaps are not hashed, so a substituted word
there doesn't break the hit. Seeds of test items and of documents are joined on their hashes, in tasks: a block of
the benchmark is small and goes to every task, however many documents there are; a benchmark of any size is taken
block by block. Every hit names a diagonal (place in the document less place in the item). Along it the words are
compared: the best stretch, with +1 for an equal word and -PENALTY for a substituted one, is the overlap.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.llm.tokens import mixed, mixed_int, pieces

#: Seeds of weight 5 and 6 over 6 to 9 words; one stands for words that are hashed.
MASKS = ("111011", "110111", "11101101", "11001101", "110100111")
#: Bits of the table that sorts out document seeds before they are looked up.
FILTER_BITS = 22
#: Bytes of benchmark text that are sent to tasks at a time.
BLOCK_BYTES = 16 << 20
#: A substituted word costs as much as so many equal words: at least 80 % of a stretch's words are equal.
PENALTY = 4


def _seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window, over row ends too."""
    count = max(0, len(words) - len(mask) + 1)
    out = np.full(count, mixed_int(sum(1 << i for i, x in enumerate(mask) if x == "1")), dtype=np.uint64)
    for i, x in enumerate(mask):
        if x == "1":
            out += words[i : i + count] * np.uint64(mixed_int(i + 11) | 1)
    return mixed(out)


def _windows(bounds: np.ndarray, span: int, count: int) -> np.ndarray:
    """Which of count windows lie within one row."""
    inside = np.ones(count, dtype=bool)
    for cut in range(1, span):
        at = bounds[1:-1] - cut
        inside[at[(at >= 0) & (at < count)]] = False
    return inside


class Block:
    """A block of test items: their words, and for each mask its seeds in order with their places."""

    def __init__(self, texts: pa.Array, least: int):
        words, bounds = [], [0]
        for _, _, part in pieces(texts):
            words.append(part.hashes(lower=True))
            bounds += (part.bounds[1:] + bounds[-1]).tolist()
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.bounds = np.array(bounds)
        long = np.repeat(np.diff(self.bounds) >= least, np.diff(self.bounds))
        self.seeds = []
        for mask in MASKS:
            seeds = _seeds(self.words, mask)
            places = np.flatnonzero(_windows(self.bounds, len(mask), len(seeds)) & long[: len(seeds)])
            order = places[np.argsort(seeds[places], kind="stable")]
            table = np.zeros(1 << FILTER_BITS, dtype=bool)
            table[seeds[order] >> np.uint64(64 - FILTER_BITS)] = True
            self.seeds.append((mask, seeds[order], order, np.packbits(table)))


def _best(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, end and equal words of the stretch with the most points; the first of several."""
    points = np.concatenate([[0], np.cumsum(np.where(equal, 1, -PENALTY))])
    gain = points - np.minimum.accumulate(points)
    end = int(np.argmax(gain))
    start = int(np.argmin(points[: end + 1])) if end else 0
    return start, end, int(equal[start:end].sum())


def _overlaps(block: Block, words: np.ndarray, bounds: np.ndarray, least: int, share: float):
    """(row, item, start, end, item start, equal words) of verified overlaps, the best of each row and item."""
    found: dict[tuple[int, int], tuple[int, ...]] = {}
    tried: list[np.ndarray] = []
    for mask, seeds, places, table in block.seeds:
        hashes = _seeds(words, mask)
        high = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        hit = ((table[high >> 3] >> (7 - (high & 7)).astype(np.uint8)) & 1).astype(bool)
        hit &= _windows(bounds, len(mask), len(hashes))
        at = np.flatnonzero(hit)
        left, right = np.searchsorted(seeds, hashes[at], "left"), np.searchsorted(seeds, hashes[at], "right")
        count = right - left
        where = np.repeat(at, count)
        inner = np.arange(len(where)) - np.repeat(np.cumsum(count) - count, count)
        place = places[np.repeat(left, count) + inner]
        row = np.searchsorted(bounds, where, "right") - 1
        item = np.searchsorted(block.bounds, place, "right") - 1
        tried.append(np.stack([row, item, (where - bounds[row]) - (place - block.bounds[item])], axis=1))
    if not tried or not sum(map(len, tried)):
        return found
    for row, item, shift in np.unique(np.concatenate(tried), axis=0).tolist():
        size, length = int(block.bounds[item + 1] - block.bounds[item]), int(bounds[row + 1] - bounds[row])
        first, last = max(0, -shift), min(size, length - shift)
        ours = words[bounds[row] + first + shift : bounds[row] + last + shift]
        start, end, equal = _best(ours == block.words[block.bounds[item] + first : block.bounds[item] + last])
        if equal >= max(least, math.ceil(share * size)):
            kept = (first + shift + start, first + shift + end, first + start, equal)
            if (row, item) not in found or (equal, -kept[0]) > (found[row, item][3], -found[row, item][0]):
                found[row, item] = kept
    return found


def benchmark_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least_words: int = 8,
    least_share: float = 0.5,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document row and test item that overlap: id, item id, word_start, word_end, item_start, words_equal, share.

    An overlap is a run of words in the same order as in the item, A-Z in lower case, with substitutions (at least
    80 % of the words equal), of at least ``least_words`` equal words and ``least_share`` of the item's words. Items with
    fewer words are not looked for. word_start and word_end count the document's words. Null or empty texts overlap
    with nothing; repeated rows give repeated results; null ids are kept; other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    schema = (
        f"{id_col} {id_type}, {item_col} {item_type}, word_start bigint, word_end bigint, "
        "item_start bigint, words_equal bigint, share double"
    )
    names = [id_col, item_col, "word_start", "word_end", "item_start", "words_equal", "share"]

    def searched(number: int) -> DataFrame:
        here = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number).toArrow().sort_by("item")
        sent = spark.sparkContext.broadcast((here["item"].combine_chunks(), Block(here["text"].combine_chunks(), least_words)))

        def run(batches):
            ids, block = sent.value
            for batch in batches:
                for first, _, texts in pieces(batch.column(1)):
                    found = _overlaps(block, texts.hashes(lower=True), texts.bounds, least_words, least_share)
                    if not found:
                        continue
                    keys = sorted(found)
                    rows = pa.array([first + k[0] for k in keys])
                    which = np.array([k[1] for k in keys])
                    values = np.array([found[k] for k in keys])
                    share = values[:, 3] / np.diff(block.bounds)[which]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), ids.take(pa.array(which)), *map(pa.array, values.T), pa.array(share)],
                        names,
                    )

        return docs.select(id_col, text_col).mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [searched(i) for i in range(blocks)])
