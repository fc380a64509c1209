"""Whitening, min-max near-duplicates and collocations on small tables: against plain versions, and on odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadweave.llm import collocations as phrases
from quadweave.llm import minmax, queries
from quadweave.llm.collocations import collocations
from quadweave.llm.minmax import min_max_bands, missed, near_duplicates
from quadweave.llm.whitening import bidiagonalise, whitened_vectors
from test_operators import components_by_hand, odd, texts  # noqa: F401

SMALL = "/root/testdata/sf0.001"


# --- whitening ---------------------------------------------------------------------------------


def whitened_by_hand(vectors, components=8):
    """By id: deviation and whitened values; shares of variance."""
    rows = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in rows], dtype=np.int64)
    n, total = len(x), x.sum(axis=0)
    y = x - total / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:components]
    deviation = [sum(int(c) ** 2 for c in n * row - total) for row in x]
    return rows, deviation, y @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_against_eigenvectors(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", F.slice("embedding", 1, 12).alias("embedding"))
    rows, deviation, whitened, explained = whitened_by_hand([tuple(r) for r in table.collect()])
    found = whitened_vectors(table).collect()
    assert len(found) == 8 * len(rows) and {r.n for r in found} == {len(rows)}
    at = {i: k for k, (i, _) in enumerate(rows)}
    values = np.zeros((len(rows), 8))
    for r in found:
        assert r.deviation == deviation[at[r.vec_id]]
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-10 and r.identity_error < 1e-10
        values[at[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(values * np.sign((values * whitened).sum(axis=0)) - whitened).max() < 1e-9


@pytest.mark.parametrize("spectrum", [[9, 9, 9, 4, 4, 1, 1, 1, 1, 0.5], [100, 50, 1e-3, 1e-4, 1e-5, 0, 0, 0, 0, 0], [1] * 10])
def test_bidiagonalisation_finds_repeated_and_missing_values(spectrum):
    rng = np.random.default_rng(3)
    turn, _ = np.linalg.qr(rng.standard_normal((10, 10)))
    left, _ = np.linalg.qr(rng.standard_normal((40, 10)))
    x = left @ np.diag(np.sqrt(spectrum)) @ turn.T
    values, vectors = bidiagonalise(lambda w: x.T @ (x @ w), 10, float((x * x).sum()), 6)
    assert np.allclose(values, spectrum[:6], rtol=1e-12, atol=1e-12 * spectrum[0])
    assert np.abs(vectors.T @ vectors - np.eye(6)).max() < 1e-12
    assert np.abs(x.T @ (x @ vectors) - vectors * values).max() < 1e-11 * spectrum[0]


def test_bidiagonalisation_ends_early_only_when_nothing_can_be_missed():
    rng = np.random.default_rng(4)
    turn, _ = np.linalg.qr(rng.standard_normal((60, 60)))
    spectrum = np.concatenate([[1000.0, 500, 200], np.full(57, 1e-6)])
    passes = []

    def product(w):
        passes.append(1)
        return turn @ (spectrum * (turn.T @ w))

    values, _ = bidiagonalise(product, 60, float(spectrum.sum()), 3)
    assert np.allclose(values, spectrum[:3], rtol=1e-13) and len(passes) < 20


def test_whitening_of_odd_rows(spark):
    schema = "vec_id bigint, embedding array<float>, component string, n int, x int, id string"
    good = [[0.5, -0.25, 0.0], [0.1, 0.2, 0.3], [0.5, -0.25, 0.0], [-0.7, 0.9, 0.4]]
    bad = [None, [], [0.1, None, 0.2], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1.0, 2.0]]
    rows = [(i if i != 1 else None, v, "c", 1, 2, "i") for i, v in enumerate(good + bad)]
    found = whitened_vectors(spark.createDataFrame(rows, schema)).collect()
    ids = Counter(r.vec_id for r in found)
    assert ids == {0: 2, None: 2, 2: 2, 3: 2} and {r.n for r in found} == {4}
    same = {(r.component, r.whitened) for r in found if r.vec_id == 0}
    assert same == {(r.component, r.whitened) for r in found if r.vec_id == 2}
    for few in (rows[:0], rows[4:5], rows[:1], [rows[0], rows[2]]):  # nothing, nothing usable, no variance
        assert whitened_vectors(spark.createDataFrame(few, schema)).collect() == []
    with pytest.raises(Exception, match="entry beyond"):
        whitened_vectors(spark.createDataFrame([(1, [1e30], "c", 1, 2, "i")], schema)).collect()


# --- near-duplicates ---------------------------------------------------------------------------


def test_signatures_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(5)
    shared, mine, yours = (rng.integers(0, 1 << 48, size, dtype=np.uint64) for size in (800, 100, 100))
    sets = [np.unique(np.concatenate([shared, own])) for own in (mine, yours)]
    bands = min_max_bands(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]), 400, 1)
    assert bands.shape == (2, 800)
    assert abs((bands[0] == bands[1]).mean() - 0.8) < 0.05
    assert missed(0.8, 64, 4) < 1e-7


@pytest.mark.parametrize(("words", "similarity", "short"), [(2, (4, 5), 8), (2, (1, 2), 2), (5, (4, 5), 2)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, words, similarity, short):
    monkeypatch.setattr(minmax, "SHORT_BUCKET", short)
    monkeypatch.setattr(minmax, "BLOCK_CLASSES", 4)
    monkeypatch.setattr(minmax, "PARTNERS", 2)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = 4 if similarity == (4, 5) else 2
    found = near_duplicates(docs, words=words, similarity=similarity, rows=rows).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components_by_hand(texts(docs), words, *similarity)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_a_chain_of_near_duplicates_in_long_buckets(spark):
    """Many copies, each with words of its own: neighbours link, ends do not; all are one component."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[: 100 - i] + [f"new{j}" for j in range(i)] + base[100:])) for i in range(40)]
    rows += [(100 + i, " ".join(f"{i}x{j}" for j in range(50))) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert found == components_by_hand(dict(rows), 2, 4, 5)


def test_near_duplicates_of_odd_rows(odd):  # noqa: F811
    found = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(odd).collect()]
    assert len(found) == odd.count()
    assert {x for x in found if x[0] in (1, 2, 3)} == {(i, 0, i, True) for i in (1, 2, 3)}
    assert sorted(x for x in found if x[0] in (4, 5)) == [(4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False)]
    assert {x[2:] for x in found if x[0] in (6, 7)} == {(6, True), (6, False)}
    assert sorted(x[1:] for x in found if x[0] is None) == [(0, None, True), (4, None, True)]
    assert near_duplicates(odd.limit(0)).collect() == []


# --- collocations ------------------------------------------------------------------------------


def collocations_by_hand(rows, words, least, first):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            found = re.findall(r"[^ \t]+", piece)
            sizes[lang] += len(found)
            for m in range(1, words + 1):
                for i in range(len(found) - m + 1):
                    key = (lang, tuple(found[i : i + m]))
                    counts[key] = counts.get(key, 0) + 1
    frequent = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, phrase), a in frequent.items():
        k, m = None, len(phrase)
        if any(
            100 * b >= 50 * a and other == lang and any(longer[i : i + m] == phrase for i in range(len(longer) - m + 1))
            for (other, longer), b in frequent.items()
            if len(longer) > m
        ):
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, phrase[:k]] * counts[lang, phrase[k:]]), k) for k in range(1, m)]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), counts[lang, phrase[:k]], counts[lang, phrase[k:]]))
    return {
        (lang, i + 1, phrase.decode(), -a, l, r, sizes[lang], -score)
        for lang, found in out.items()
        for i, (score, a, phrase, l, r) in enumerate(sorted(found)[:first])
    }


@pytest.mark.parametrize(("words", "least", "first", "chunk"), [(3, 10, 2000, 1 << 23), (4, 3, 50, 1 << 10), (2, 5, 7, 1 << 14)])
def test_collocations_against_counting(spark, monkeypatch, words, least, first, chunk):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id % 4 = 0")
    found = collocations(docs, words=words, least=least, first=first).collect()
    expected = collocations_by_hand([(r.lang, r.text) for r in docs.collect()], words, least, first)
    assert len(found) == len(expected) and {tuple(r) for r in found} == expected


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_BITS", 6)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id % 4 = 1")
    found = collocations(docs, least=3).collect()
    assert {tuple(r) for r in found} == collocations_by_hand([(r.lang, r.text) for r in docs.collect()], 3, 3, 2000)


def test_collocations_of_odd_rows(spark):
    schema = "doc_id bigint, lang string, text string, phrase string, f int, rank int, prefix string"
    long = "Äpfel und Birnen " * 20_000
    rows = [
        (1, None, "New York, new york\tNEW YORK"), (2, "en", None), (3, "en", ""), (4, "en", " .;: \t\n"),
        (5, "de", long), (5, "de", "und Birnen\x0bund Birnen"), (None, "fr", "a a a a"), (None, "fr", "a a a a"), (6, "", "x y x y"),
    ]
    table = spark.createDataFrame([(*r, "p", 1, 2, "q") for r in rows], schema)
    found = {tuple(r) for r in collocations(table, least=2).collect()}
    assert found == collocations_by_hand([r[1:] for r in rows], 3, 2, 2000)
    assert ("und", 1, "new york", 3, 3, 3, 6, 1_000_000) in found
    assert collocations(table.limit(0)).collect() == []
    assert collocations(table.filter("doc_id IN (2, 3, 4)")).collect() == []


def test_new_queries_are_registered():
    names = {"op11_embedding_whitening", "op12_minhash_near_dedup", "op13_phrase_collocations"}
    assert names <= set(queries.QUERIES) and set(queries.ORACLES) & names == names - {"op11_embedding_whitening"}
