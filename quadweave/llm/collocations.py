"""Phrase collocations by the stripes pattern.

A prefix of k words keys a stripe: how often each word follows it, with a null for the end of its piece. Tasks make the
stripes of some megabytes of text at a time; a stripe is cut by the hash of the next word into `parts` rows, so that
no prefix is one task's alone. Spark shuffles the rows by (lang, prefix, part) and adds them up element by element where
they land. A merged stripe gives

- the extensions of its prefix: the phrases of k + 1 words that occur often enough,
- the prefix's total, which for k = 1 is the word's count,
- by the largest of its extensions, what may subsume the prefix.

Stripes of longer prefixes only count phrases whose first and last k words occur often enough: a bitmap of these, sized by
their number, goes to the tasks. What it lets through wrongly is dropped after counting, so it never changes a result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadweave.llm.common import bitmap, in_bitmap, shared_table
from quadweave.llm.tokens import LOWER, give_back

#: Bytes that end a piece, bytes between words.
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"

#: Bytes of text that a task makes into stripes at a time (a longer text alone).
CHUNK = 1 << 23
#: Bits of a bitmap for each phrase in it, and log2 of its bits at most (16 MB).
BITS_EACH, MOST_BITS = 16, 27
#: Shares of a language's candidates that are ranked apart before they are ranked together.
RANK_SHARES = 64
_SEED = 42  # of Spark's xxhash64

_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(BREAKS)] = True
_SOLID = ~_ENDS
_SOLID[list(BLANKS)] = False


class Words:
    """The words of some rows of text: codes in a dictionary, each word's row, and whether the next one is in its piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        solid = _SOLID[data]
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        begin[cuts] = solid[cuts]
        end[cuts - 1] = solid[cuts - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        letters = LOWER[data[solid]]
        bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(letters))
        coded = words.dictionary_encode()
        self.names = coded.dictionary.cast(pa.string())
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.rows = np.searchsorted(offsets, starts, side="right") - 1
        piece = np.cumsum(_ENDS[data])[starts] if len(starts) else np.zeros(0, np.int64)
        self.joined = np.zeros(len(starts), dtype=bool)
        self.joined[:-1] = (self.rows[1:] == self.rows[:-1]) & (piece[1:] == piece[:-1])

    def hashes(self) -> np.ndarray:
        """By code, the hash that Spark's xxhash64 gives."""
        return _hashes(self.names)


def _hashes(names: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x, _SEED) for x in names.to_pylist()], dtype=np.uint64)


def _step(seed: np.ndarray, word: np.ndarray) -> np.ndarray:
    return ((seed << np.uint64(13)) | (seed >> np.uint64(51))) ^ word


_STEP_SQL = "aggregate(split(phrase, ' '), xxhash64(lang), (h, w) -> (shiftleft(h, 13) | shiftrightunsigned(h, 51)) ^ xxhash64(w))"


def _chunks(batch: pa.RecordBatch):
    """Runs of rows (langs, data, offsets) of about CHUNK bytes."""
    langs = batch.column(0)
    texts = batch.column(1).cast(pa.large_string())
    texts = texts.fill_null("") if texts.null_count else texts
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        yield langs.slice(first, end - first), data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def _striped(langs: pa.Array, words: Words, length: int, parts: int, wanted) -> pa.RecordBatch | None:
    """Stripes of all prefixes of `length` words: lang, prefix, part, and by next word how often it follows."""
    size = len(words.names)
    named = langs.dictionary_encode()
    lang = named.indices.to_numpy().astype(np.int64)[words.rows]
    count = len(words.codes)
    starts = np.arange(max(0, count - length + 1))
    for j in range(length - 1):
        starts = starts[words.joined[starts + j]]
    if wanted is not None:  # both shorter phrases of a longer one must be frequent
        starts = starts[words.joined[starts + length - 1]]
        by_code, by_lang = words.hashes(), _hashes(named.dictionary)
        hashed = []
        for shift in (0, 1):
            h = by_lang[lang[starts]]
            for j in range(length):
                h = _step(h, by_code[words.codes[starts + shift + j]])
            hashed.append(in_bitmap(wanted, h))
        starts = starts[hashed[0] & hashed[1]]
    if not len(starts):
        return None
    group = lang[starts]
    for j in range(length):  # number the prefixes, a word at a time, so that numbers stay short
        _, example, group = np.unique(group * size + words.codes[starts + j], return_index=True, return_inverse=True)
    example = starts[example]
    last = starts + length - 1
    following = np.where(words.joined[last], words.codes[np.minimum(last + 1, count - 1)], size)
    place = np.array([xxhash.xxh32_intdigest(x) % parts for x in words.names.to_pylist()] + [0], dtype=np.int64)
    key, times = np.unique((group * parts + place[following]) * (size + 1) + following, return_counts=True)
    stripe, following = np.divmod(key, size + 1)
    heads = np.flatnonzero(np.concatenate([[True], stripe[1:] != stripe[:-1]]))
    bounds = pa.array(np.append(heads, len(key)).astype(np.int32))
    number, part = np.divmod(stripe[heads], parts)
    example = example[number]
    prefix = [words.names.take(pa.array(words.codes[example + j])) for j in range(length)]
    following = words.names.take(pa.array(following, mask=following == size))
    return pa.RecordBatch.from_arrays(
        [
            named.dictionary.take(pa.array(lang[example])),
            pc.binary_join_element_wise(*prefix, " ") if length > 1 else prefix[0],
            pa.array(part.astype(np.int32)),
            pa.ListArray.from_arrays(bounds, following),
            pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int32))),
        ],
        ["lang", "prefix", "part", "following", "times"],
    )


def merged_stripes(texts: DataFrame, length: int, least: int, parts: int, wanted: np.ndarray | None = None) -> DataFrame:
    """(lang, prefix, part, total, often) of texts (lang, text): often holds (next, f) for what follows at least `least` times."""
    sent = None if wanted is None else texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for batch in batches:
            for langs, data, offsets in _chunks(batch):
                found = _striped(langs, Words(data, offsets), length, parts, sent and sent.value)
                if found is not None:
                    yield found
            give_back()

    made = texts.mapInArrow(run, "lang string, prefix string, part int, following array<string>, times array<int>")
    # a stripe's rows meet in one task; there its elements are added up without a further shuffle
    met = made.repartition("lang", "prefix", "part").select(
        "lang", "prefix", "part", F.inline(F.arrays_zip("following", "times"))
    )
    added = met.groupBy("lang", "prefix", "part", "following").agg(F.sum("times").alias("f"))
    often = F.collect_list(F.when(F.col("following").isNotNull() & (F.col("f") >= least), F.struct(F.col("following").alias("next"), "f")))
    return added.groupBy("lang", "prefix", "part").agg(F.sum("f").alias("total"), often.alias("often"))


def frequent_phrases(texts: DataFrame, words: int, least: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, f) of all phrases of 1 to `words` words that occur at least `least` times, and (lang, n)."""
    stripes = shared_table(merged_stripes(texts, 1, least, parts), "stripes-1")
    totals = shared_table(stripes.groupBy("lang", "prefix").agg(F.sum("total").alias("f")), "words")
    found = totals.filter(F.col("f") >= least).select("lang", F.col("prefix").alias("phrase"), F.lit(1).alias("m"), "f")
    for m in range(2, words + 1):
        here = stripes.select("lang", "prefix", F.inline("often")).select(
            "lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), F.lit(m).alias("m"), "f"
        )
        found = found.union(here)
        if m < words:
            bits = min(MOST_BITS, max(16, math.ceil(math.log2(BITS_EACH * here.count() + 1))))
            wanted = bitmap(here.select(F.expr(_STEP_SQL).alias("h")), "h", bits)
            stripes = shared_table(merged_stripes(texts, m, least, parts, wanted), f"stripes-{m}")
    return shared_table(found, "phrases"), totals.groupBy("lang").agg(F.sum("f").alias("n"))


def collocations(
    docs: DataFrame,
    *,
    lang_col: str = "lang",
    text_col: str = "text",
    words: int = 3,
    least: int = 10,
    subsumed_percent: int = 50,
    first: int = 2000,
    parts: int = 8,
) -> DataFrame:
    """Each language's ``first`` phrases of 2 to ``words`` words: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; texts are cut at . , ; : ! ? and line ends into pieces, and these at blanks and tabs into words.
    A phrase that occurs a >= ``least`` times within pieces is a candidate. For each cut into a first part, which occurs
    l times, and a rest, which occurs r times, the score is floor(1000000 a a / (l r)), and the lowest counts (of equal ones
    the earliest cut). Candidates inside a longer one that occurs at least ``subsumed_percent`` percent as often go. Ranks
    are by score, then a (both falling), then phrase in byte order; n counts all words of the language.

    A stripe is spread over ``parts`` tasks; more of them cost more rows for rare prefixes.

    A null language is 'und', null and empty texts have no words; repeated rows count as often as they come. Ids and other
    columns are ignored. An empty table gives no rows. Arithmetic is exact (decimals of 38 digits; more is an error).
    """
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    found, sizes = frequent_phrases(texts, words, least, parts)
    phrases = found.filter("m > 1")
    inside = (
        found.filter("m > 2")
        .select("lang", "f", F.split("phrase", " ").alias("w"))
        .select("lang", "f", F.explode(F.expr("array(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1))")).alias("w"))
        .groupBy("lang", F.array_join("w", " ").alias("phrase"))
        .agg(F.max("f").alias("longer"))
    )
    kept = (
        phrases.join(inside, ["lang", "phrase"], "left")
        .filter(F.expr(f"longer IS NULL OR 100BD * longer < {subsumed_percent} * f"))
        .select("lang", "phrase", F.col("f").alias("a"))
    )
    cuts = (
        kept.withColumn("w", F.split("phrase", " "))
        .select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
        .select(
            "lang", "phrase", "a", "k",
            F.expr("array_join(slice(w, 1, k), ' ')").alias("head"),
            F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("rest"),
        )
    )
    heads = found.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr("1000000BD * cast(a as decimal(19, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    scored = (
        cuts.join(heads, ["lang", "head"])
        .join(rests, ["lang", "rest"])
        .select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
        .groupBy("lang", "phrase", "a")
        .agg(F.min("cut").alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(RANK_SHARES))
    for by in (["lang", share], ["lang"]):
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= first)
    return scored.join(F.broadcast(sizes) if sizes.count() <= 1 << 16 else sizes, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
