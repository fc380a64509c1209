"""Lines that differ by two substitutions are near lines by default."""

import random

import pytest
from pyspark.sql import functions as F

from quadweave.llm.line_dedup import dedup_lines, within_edits


def test_two_edits_by_default(spark):
    line = "a line of ninety characters and more that differs from another in rere {} aner by a word only, no more"
    texts = ["\n".join([line.format("or"), "something else entirely"]), line.format("ha"), line.format("xyz")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: (r.n_dropped, r.n_near) for r in dedup_lines(docs).collect()}
    assert found == {0: (0, 0), 1: (1, 1), 2: (0, 0)}


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance_is_the_edit_distance(spark, edits):
    draw = random.Random(edits)
    rows = []
    for _ in range(1500):
        line = [draw.choice("abcé😀") for _ in range(draw.randint(edits + 1, 40))]
        other = list(line)
        for _ in range(draw.randint(0, edits + 2)):
            at = draw.randrange(len(other) + 1)
            other[at : at + draw.randint(0, 1)] = draw.choice(["", "a", "é", "😀"])
        if len(other) > edits:
            rows.append(("".join(line), "".join(other)))
    pairs = spark.createDataFrame(rows, "l string, r string")
    judged = pairs.select("l", "r", within_edits("l", "r", edits).alias("near"), (F.levenshtein("l", "r") <= edits).alias("truth"))
    assert [r for r in judged.collect() if r.near != r.truth] == []
    assert judged.filter("truth").count() > 100 and judged.filter("NOT truth").count() > 100
