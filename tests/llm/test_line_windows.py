"""Long files of lines: rows of pairs don't grow with the square, and no link is lost."""

import random

import pytest
from pyspark.sql import functions as F

from quadweave.llm import line_dedup
from quadweave.llm.line_dedup import letter_counts, line_classes, window_pairs


def _near(draw, line, edits, letters):
    line = list(line)
    for _ in range(edits):
        at = draw.randrange(len(line))
        line[at : at + draw.randint(0, 1)] = draw.choice(letters) * draw.randint(0, 1)
    return "".join(line)


def _classes(links, nodes):
    group = {n: n for n in nodes}

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        group[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize(("edits", "size"), [(1, 20), (2, 20), (3, 17)])
def test_windows_lose_no_link(spark, monkeypatch, edits, size):
    monkeypatch.setattr(line_dedup, "SHORT_FILE", 2)
    draw = random.Random(edits * size)
    base = "".join(draw.choice("abé") for _ in range(size))
    lines = {_near(draw, base, draw.randint(0, edits + 2), "abé😀") for _ in range(130)} | {("ab" * size)[:size], ("ba" * size)[: size + 1]}
    frame = spark.createDataFrame([(x,) for x in sorted(lines)], "line string")
    frame = frame.select(F.xxhash64("line").alias("h"), "line", letter_counts(F.col("line")).alias("letters")).localCheckpoint()
    left, right = (frame.select(F.col("h").alias(n), F.col("line").alias(t)) for n, t in (("a", "l"), ("b", "r")))
    both = left.join(right, F.col("a") < F.col("b")).filter(F.levenshtein("l", "r", edits) >= 0)
    truth = [tuple(r) for r in both.select("a", "b").collect()]
    met = {tuple(r) for table in window_pairs(frame, edits) for r in table.collect()}
    nodes = [r.h for r in frame.collect()]
    assert len(truth) > 20 and _classes(met & set(truth), nodes) == _classes(truth, nodes)


def test_pairs_of_a_long_file_are_few(spark, monkeypatch):
    draw = random.Random(5)
    base = "".join(draw.choice("eantiros bcd") for _ in range(120))
    lines = set()
    while len(lines) < 400:  # a word of the same letters in another order, somewhere: many edits, equal counts
        at = draw.randrange(len(base))
        lines.add(base[:at] + "".join(draw.sample("nearst", 6)) + base[at:])
    lines = sorted(lines) + [base[:70] + "x" + base[71:], base[:70] + "y" + base[71:]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    written, table = [], line_dedup.shared_table
    monkeypatch.setattr(line_dedup, "shared_table", lambda frame, what: written.append((what, table(frame, what))) or written[-1][1])
    found = {r.id: r["class"] for r in line_classes(docs, id_col="doc_id", text_col="text", edits=2, least_chars=16).collect()}
    left, right = (docs.toDF(n, t) for n, t in (("a", "l"), ("b", "r")))
    truth = [tuple(r) for r in left.join(right, F.expr("a < b AND levenshtein(l, r, 2) >= 0")).select("a", "b").collect()]
    groups = _classes(truth, range(len(lines)))
    assert len(set(groups.values())) == len(set(found.values())) == len(set(zip(groups.values(), (found[i] for i in groups), strict=True)))
    pairs = sum(t.count() for what, t in written if what == "line-pairs")
    assert pairs < 20 * len(lines)  # all meeting pair by pair, as before: 58,801
