"""Blocks of a large group meet in turns; what the n-gram join keeps on disk does not grow with the square of a group."""

import itertools
import os
import random
import time
from collections import Counter
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F
from test_operators import components_by_hand, texts

from quadweave.llm import common, ngram_join
from quadweave.llm.ngram_join import ngram_components


def near_copies(count, words, edits, seed=7):
    """Texts that differ from one text in up to `edits` words, each with its id."""
    draw = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for key in range(count):
        text = list(base)
        for _ in range(draw.randint(1, edits)):
            text[draw.randrange(words)] = f"x{draw.randrange(10**9)}"
        rows.append((key, " ".join(text)))
    return rows


@pytest.mark.parametrize("share", [0.1, 1, 2.5, 1000])
def test_every_two_blocks_meet_once(spark, share):
    groups = {"one": 1, "two": 2, "three": 3, "six": 6, "eleven": 11, "twelve": 12}
    dealt = spark.createDataFrame(
        [(g, 0, k * 100 + b, 10, n, b) for k, (g, n) in enumerate(groups.items()) for b in range(n)],
        "component string, band int, sig bigint, n bigint, blocks int, block int",
    )
    sets = dealt.select("sig", F.lit(b"").alias("grams"))
    grams = {n: 10 * n for n in groups.values()}
    most = share * sum(grams.values())
    met = Counter()
    for turn in ngram_join._turns(grams, most):
        rows = ngram_join._meetings(sets, dealt, *turn).collect()
        if turn[3] == 1:
            assert sum(r.n for r in rows) <= most
        pairs = {}
        for r in rows:
            pairs.setdefault((r.component, r.i, r.distance), []).append(r.sig % 100)
        met.update((component, tuple(sorted(sigs))) for (component, _, _), sigs in pairs.items())
    expected = {(g, p) for g, n in groups.items() for p in [*itertools.combinations(range(n), 2), *((b,) for b in range(n))]}
    assert met == Counter(expected)


def test_a_large_group_moves_in_bounded_turns(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 8)
    monkeypatch.setattr(ngram_join, "LONG_LIST", 8)
    rows = near_copies(150, 60, 6) + [(1000 + k, " ".join(f"u{k}x{i}" for i in range(60))) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    moved, turns, links, write = spark.sparkContext.accumulator(0), [], ngram_join._block_links, common.shared_table

    def counted(*similarity):
        forest = links(*similarity)

        def run(frame):
            moved.add(int(frame["n"].sum()))
            return forest(frame)

        return run

    def watched(frame, purpose):
        before = moved.value
        table = write(frame, purpose)
        turns.append(moved.value - before)
        return table

    monkeypatch.setattr(ngram_join, "_block_links", counted)
    for module in (common, ngram_join):
        monkeypatch.setattr(module, "shared_table", watched)
    found = ngram_components(docs, words=3).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components_by_hand(texts(docs), 3, 4, 5)
    total = sum(r.n_shingles for r in found)
    assert sum(turns) > 4 * total  # the blocks of the group all meet
    assert max(turns) <= total


def test_sets_of_documents_that_meet_none_are_not_written(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(k, " ".join(f"{draw.randrange(10**6)}" for _ in range(2000))) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    written, write = [], common.shared_table

    def watched(frame, purpose):
        table = write(frame, purpose)
        written.extend(os.path.getsize(unquote(urlparse(f).path)) for f in table.inputFiles())
        return table

    for module in (common, ngram_join):
        monkeypatch.setattr(module, "shared_table", watched)
    found = ngram_components(docs).collect()
    assert all(r.component_id == r.doc_id for r in found)
    assert sum(written) < 6 * sum(r.n_shingles for r in found)  # a set's n-grams take 6 bytes each


def test_shuffle_files_go_when_a_table_is_written(spark):
    jvm = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for f in jvm.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}

    before = files()
    table = common.shared_table(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count().repartition(5), "few")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert table.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
