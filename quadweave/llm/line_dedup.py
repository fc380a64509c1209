"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Two lines within `edits` edits share at least one of the edits + 1 segments of the shorter, at a place that is shifted
by no more than the lengths allow. Every distinct line files its segments under (its length, segment number,
segment) and probes the files of all lengths from its own down to `edits` less, at the places where a shared segment
may stand if the matches to its left and right are counted (multi-match-aware). A first pass finds the keys at which
different lines meet; only entries of those are kept. Lines of short files meet pair by pair. Lines of long files meet by
windows: halves of halves of a line that hold all the edits, with equal text around them, are made smaller until few lines
are left, or until a window is so small that it holds one edit, where all lines link to one. Pairs that meet are verified
with a banded bit-parallel edit distance. Lines connected by verified pairs are one class; the first occurrence stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.llm.common import broadcast_if_small, components, shared_table

#: Letters that are counted to tell lines apart before their texts are compared.
LETTERS = "eantiros"
#: A character that makes a line not blank.
NOT_BLANK = r"[^ \t\r\x0b\x0c]"
#: Filed lines of a key up to this many meet its probes pair by pair; more are told apart by windows. Comparing the letter
#: counts of a pair takes far less time than making the keys of a line's windows.
SHORT_FILE = 32
#: Lines of long files are halved that often before their windows are compared first.
FIRST_HALVINGS = 2


def segment_bounds(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of the edits + 1 segments of a line of that length; the last ones are one longer."""
    size, more = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        here = size + (i >= edits + 1 - more)
        out.append((at, here))
        at += here
    return out


def segment_keys(lines: DataFrame, edits: int) -> DataFrame:
    """(h, key, files) of lines (h, line, length): files tells entries of the index from probes.

    The places to look at are rows of a small constant table, not branches of one expression: code that stays short is
    compiled to machine code, a long one is not.
    """
    places = [
        (shorter, i, shift)
        for shorter in range(edits + 1)
        for i in range(edits + 1)
        for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1)
    ]
    table = F.array(
        *(F.struct(*(F.lit(x).alias(n) for n, x in zip(("shorter", "i", "shift"), place, strict=True))) for place in places)
    )
    parts = edits + 1
    at = lines.select("h", "line", "length", F.inline(table)).withColumn("other", F.expr("length - shorter"))
    long = f"i >= {parts} - other % {parts}"
    at = at.withColumns(
        {
            "start": F.expr(f"i * (other div {parts}) + greatest(i - ({parts} - other % {parts}), 0) + shift").cast("int"),
            "size": F.expr(f"other div {parts} + if({long}, 1, 0)").cast("int"),
        }
    ).filter("start >= 0 AND start + size <= length")
    # bytes are found at once where every character is one byte; else characters are counted from the line's start
    part = "if(octet_length(line) = length, substring(CAST(line AS binary), start + 1, size), CAST(substring(line, start + 1, size) AS binary))"
    key = F.expr(f"xxhash64(other, i, {part})")
    return at.select("h", key.alias("key"), F.expr("shorter = 0 AND shift = 0").alias("files"))


def letter_counts(line: Column) -> Column:
    """How often each of LETTERS occurs, 8 bits each (as many as fit)."""
    out = F.lit(0).cast("bigint")
    for letter in LETTERS:
        count = F.length(line) - F.length(F.replace(line, F.lit(letter), F.lit("")))
        out = F.shiftleft(out, 8).bitwiseOR(F.least(count, F.lit(0xFF)))
    return out


def letters_apart(x: str, y: str) -> str:
    """SQL of the sum of differences of two letter counts. An edit changes two counts by one at most."""
    field = "(shiftrightunsigned({0}, {1}) & 255)"
    return " + ".join(f"abs({field.format(x, 8 * i)} - {field.format(y, 8 * i)})" for i in range(len(LETTERS)))


def within_edits(x: str, y: str, edits: int) -> Column:
    """Whether two columns of text differ by at most that many edits (insertions, deletions, substitutions).

    Bit-parallel along a band of 2 * edits + 1 diagonals: bit t stands for row j - edits + t of column j. vp and vn say where
    distances grow or shrink by one downwards, hp where they grow to the right, d0 where they equal their upper left
    neighbour's; d is the distance in the band's last row, and later in the last row of all. Texts are code points of
    four bytes each, x with edits fillers before it.
    """
    k = edits
    full, top = (1 << (2 * k + 1)) - 1, 2 * k
    rows = f"(length(t.a) div 4 - {k})"
    same = " + ".join(f"if(substring(t.a, 4 * (j + {i}) - 3, 4) = substring(t.b, 4 * j - 3, 4), {1 << i}, 0)" for i in range(top + 1))
    last = f"({rows} - j + {k})"
    step = (
        f"if(j + {k} <= {rows}, 1 - (shiftright(d0, {top}) & 1), (shiftright(hp, {last}) & 1) - (shiftright(d0 & s.vp, {last}) & 1))"
    )
    state = (
        f"named_struct('vp', ((d0 & s.vp) | ~(shiftright(d0, 1) | hp)) & {full}, 'vn', shiftright(d0, 1) & hp, 'd', s.d + {step})"
    )
    for name, value in (
        ("hp", f"(s.vn | ~(d0 | s.vp)) & {full}"),
        ("d0", f"((((e & s.vp) + s.vp) ^ s.vp) | e | s.vn) & {full}"),
        ("e", same),
    ):
        state = f"element_at(transform(array({value}), {name} -> {state}), 1)"
    start = f"named_struct('vp', {full - (1 << k) + 1}, 'vn', 0, 'd', {k})"
    # the last columns take back at most 2 * edits: beyond three times the edits nothing can change any more
    walk = f"aggregate(sequence(1, length(t.b) div 4), {start}, (s, j) -> if(s.d > {3 * k}, s, {state}), s -> s.d <= {k})"
    texts = f"named_struct('a', concat(unhex('{'FF' * 4 * k}'), encode({x}, 'UTF-32')), 'b', encode({y}, 'UTF-32'))"
    return F.expr(f"abs(length({x}) - length({y})) <= {k} AND exists(array({texts}), t -> {walk})")


def halved_windows(rows: DataFrame, halvings: int, edits: int, times: int = 1) -> DataFrame:
    """Rows (line, length, shorter, windows) with the half or halves of each window that may hold its edits.

    A window (piece, more) is one of 2**halvings equal pieces of the shorter line, and how many characters more the longer
    line has there. It costs max(1, |more|) edits at least. Where pieces are characters with empty pieces between them
    (finest), a window is a character that is changed or left out, or an empty piece with characters put in.
    """
    both = f"filter(sequence(-{edits}, {edits}), e -> greatest(1, abs(e)) + greatest(1, abs(v.more - e)) <= {edits})"
    half = "named_struct('piece', 2 * v.piece + {0}, 'more', {1})"
    halves = (
        f"concat(array(array({half.format(0, 'v.more')}), array({half.format(1, 'v.more')})), "
        f"transform({both}, e -> array({half.format(0, 'e')}, {half.format(1, 'v.more - e')})))"
    )
    none = "array(CAST(array() AS array<struct<piece: bigint, more: int>>))"
    every = "array(windows)"
    for _ in range(times):
        every = (
            f"flatten(transform({every}, old -> aggregate(old, {none}, "
            f"(done, v) -> flatten(transform(done, x -> transform({halves}, y -> concat(x, y)))))))"
        )
    rows = rows.withColumns(
        {"least": F.expr("CAST(length - shorter AS bigint)"), "finest": F.expr(f"2 * (length - shorter) <= {1 << halvings}")}
    )
    start, end = piece_bounds(halvings)
    fits = (
        f"{end} - {start} + v.more >= 0 AND ({end} > {start} OR v.more > 0) AND NOT (finest AND {end} > {start} AND v.more > 0)"
    )
    cost = "aggregate(w, 0, (n, v) -> n + greatest(1, abs(v.more)))"
    return rows.withColumn("windows", F.explode(F.expr(f"filter({every}, w -> {cost} <= {edits} AND forall(w, v -> {fits}))")))


def piece_bounds(halvings: int) -> tuple[str, str]:
    """SQL of the start and end of window v's piece in the shorter line."""
    return tuple(f"CAST({piece} * least div {1 << halvings} AS int)" for piece in ("v.piece", "(v.piece + 1)"))


def window_keys(rows: DataFrame, halvings: int) -> DataFrame:
    """The rows with key (of the text around the windows), inside (a hash per window) and files.

    Lines that agree around the finest windows are within the edits.
    """
    start, end = piece_bounds(halvings)
    first = "named_struct('at', 0, 'shift', 0, 'around', '', 'inside', CAST(array() AS array<bigint>))"
    step = (
        f"named_struct('at', {end} + a.shift + v.more, 'shift', a.shift + v.more, "
        f"'around', concat(a.around, substring(line, a.at + 1, {start} + a.shift - a.at)), "
        f"'inside', concat(a.inside, array(xxhash64(substring(line, {start} + a.shift + 1, {end} - {start} + v.more)))))"
    )
    key = f"xxhash64(least, windows.piece, {1 << halvings}, a.around, substring(line, a.at + 1))"
    found = f"aggregate(windows, {first}, (a, v) -> {step}, a -> named_struct('key', {key}, 'inside', a.inside))"
    files = F.expr("shorter = 0 AND forall(windows, v -> v.more = 0)")
    return rows.withColumn("found", F.expr(found)).select(
        "h", "letters", "shorter", "windows", "finest", "found.key", "found.inside", files.alias("files")
    )


def pairs_of_files(keys: DataFrame, edits: int, *, inside: bool = False) -> DataFrame:
    """Pairs (a, b) of every probe, and every filed line for lines of its own length, with the filed ones of its key."""
    more = ["inside"] if inside else []
    probes = keys.select("key", F.col("h").alias("x"), F.col("letters").alias("lx"), *(F.col(c).alias("ix") for c in more))
    filed = keys.filter("files").select(
        F.col("key").alias("at"), F.col("h").alias("y"), F.col("letters").alias("ly"), *(F.col(c).alias("iy") for c in more)
    )
    apart = F.expr(letters_apart("lx", "ly"))
    on = (F.col("key") == F.col("at")) & (F.col("x") != F.col("y")) & (apart <= 2 * edits)
    if inside:  # equal windows hold no edit: the pair meets where fewer windows are left
        on = on & F.expr("forall(zip_with(ix, iy, (p, q) -> p <> q), unequal -> unequal)")
    return probes.join(filed, on).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def window_pairs(lines: DataFrame, edits: int) -> list[DataFrame]:
    """Tables of pairs (a, b) that connect all lines (h, line, letters) within the edits, and may hold others.

    Rows grow with the lines, not with their square: a line stays under a key as long as many differ from it in each of the
    key's windows, and those lines have less and less room to differ.
    """
    lines = lines.withColumn("length", F.length("line"))
    whole = "array(named_struct('piece', 0L, 'more', shorter))"
    rows = lines.withColumn("shorter", F.explode(F.array(*map(F.lit, range(edits + 1))))).filter("length > shorter")
    rows = rows.withColumn("windows", F.expr(whole))
    halvings, out = FIRST_HALVINGS, []
    rows = halved_windows(rows, halvings, edits, times=FIRST_HALVINGS)
    while True:
        rows = shared_table(window_keys(rows, halvings), "windows")
        ends = [(F.min(F.get("inside", F.lit(i))), F.max(F.get("inside", F.lit(i)))) for i in range(edits)]
        unequal = reduce(Column.__and__, (low.isNull() | (low != high) for low, high in ends))
        groups = rows.groupBy("key").agg(
            F.count_if("files").alias("n"), F.min(F.when(F.col("files"), F.col("h"))).alias("first"), unequal.alias("unequal")
        )
        groups = shared_table(groups.filter("n > 0 AND unequal").select("key", "n", "first"), "window-keys")
        rows = rows.join(broadcast_if_small(groups), "key")
        out.append(shared_table(pairs_of_files(rows.filter(F.col("n") <= SHORT_FILE), edits, inside=True), "line-pairs"))
        rows = rows.filter(F.col("n") > SHORT_FILE)
        star = rows.filter("finest AND h <> first").select(F.least("h", "first").alias("a"), F.greatest("h", "first").alias("b"))
        out.append(shared_table(star.distinct(), "line-pairs"))
        rows = shared_table(rows.filter("NOT finest").select("h", "shorter", "windows"), "crowded")
        if rows.isEmpty():
            return out
        halvings += 1
        rows = halved_windows(rows.join(lines, "h"), halvings, edits)


def line_classes(docs: DataFrame, *, id_col: str, text_col: str, edits: int, least_chars: int) -> DataFrame:
    """(id, line_no, h, class): every line that isn't blank, the hash of its text, the hash that stands for its class."""
    cut = docs.select(
        F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line_no", "line")
    ).filter(F.col("line").rlike(NOT_BLANK))
    lines = cut.select("id", "line_no", "line", F.xxhash64("line").alias("h"), F.length("line").alias("length"))
    where = shared_table(lines.select("id", "line_no", "h"), "lines")
    long = lines.filter(F.col("length") >= max(least_chars, edits + 1)).select("h", "line", "length")
    keys = segment_keys(long, edits)
    met = keys.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.max("files").alias("files"))
    met = shared_table(met.filter("files AND low <> high").select("key"), "met-keys")
    keys = keys.join(broadcast_if_small(met), "key", "left_semi").groupBy("key", "h").agg(F.max("files").alias("files"))
    keys = shared_table(keys, "segments")
    wanted = shared_table(keys.select("h").distinct(), "wanted")
    texts = long.select("h", "line").join(broadcast_if_small(wanted), "h", "left_semi").groupBy("h").agg(F.min("line").alias("line"))
    texts = shared_table(texts.withColumn("letters", letter_counts(F.col("line"))), "line-texts")
    keys = keys.join(texts.select("h", "letters"), "h")
    long_files = keys.groupBy("key").agg(F.count_if("files").alias("n")).filter(F.col("n") > SHORT_FILE).select("key")
    long_files = shared_table(long_files, "long-files")
    pairs = shared_table(pairs_of_files(keys.join(broadcast_if_small(long_files), "key", "left_anti"), edits), "line-pairs")
    if not long_files.isEmpty():
        crowd = shared_table(keys.join(broadcast_if_small(long_files), "key", "left_semi").select("h").distinct(), "crowd")
        crowd = texts.join(broadcast_if_small(crowd), "h", "left_semi")
        pairs = reduce(DataFrame.union, window_pairs(crowd, edits), pairs).distinct()
    linked = (
        pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("l")), "a")
        .join(texts.select(F.col("h").alias("b"), F.col("line").alias("r")), "b")
        .filter(within_edits("l", "r", edits))
        .select("a", "b")
    )
    classes = shared_table(components(linked).withColumnRenamed("node", "h"), "classes")
    return where.join(broadcast_if_small(classes), "h", "left").select(
        "id", "line_no", "h", F.coalesce("component", "h").alias("class")
    )


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, least_chars: int = 16
) -> DataFrame:
    """One row per document id: id, n_lines, n_dropped, dropped (line numbers from 0), n_near.

    A line is dropped if an equal line, or one of its class (lines of at least ``least_chars`` characters that steps of at
    most ``edits`` edits connect), comes before it: in a document with a smaller id, or above it. n_near counts the
    dropped lines whose text differs from the one that stays. Blank lines always stay and are not counted. Rows that
    share an id are one document; a null id comes first. Null and empty texts have no lines. Other columns are ignored.
    """
    found = line_classes(docs, id_col=id_col, text_col=text_col, edits=edits, least_chars=least_chars)
    order = F.struct(F.coalesce(F.col("id"), F.lit(-(1 << 63))).alias("id"), "line_no")
    first = found.groupBy("class").agg(F.min(F.struct(order.alias("at"), "h")).alias("first"), F.count("*").alias("n"))
    first = first.filter("n > 1").select("class", "first")
    judged = found.join(first, "class", "left").select(
        "id",
        "line_no",
        (F.col("first").isNotNull() & (F.col("first.at") != order)).alias("drop"),
        (F.col("first.h") != F.col("h")).alias("near"),
    )
    per_doc = judged.groupBy("id").agg(
        F.count("*").alias("n_lines"),
        F.count_if("drop").alias("n_dropped"),
        F.array_sort(F.collect_list(F.when(F.col("drop"), F.col("line_no")))).alias("dropped"),
        F.count_if(F.col("drop") & F.col("near")).alias("n_near"),
    )
    ids = docs.select(F.col(id_col).alias("doc")).distinct()
    return ids.join(per_doc, F.col("doc").eqNullSafe(F.col("id")), "left").select(
        F.col("doc").alias(id_col),
        *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_lines", "n_dropped")),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
    )


def without_lines(docs: DataFrame, dropped: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the dropped lines taken out of the text."""
    lists = dropped.select(F.col(id_col).alias("_id"), F.col("dropped").alias("_dropped"))
    kept = F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains("_dropped", i))
    joined = docs.join(lists, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    return joined.withColumn(
        text_col, F.when(F.size("_dropped") > 0, F.array_join(kept, "\n")).otherwise(F.col(text_col))
    ).select(docs.columns)
