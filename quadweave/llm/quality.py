"""Quality classifier: averaged vectors of hashed word and character n-grams, softmax, stochastic gradient descent.

Three kinds of features share one table of vectors: words, pairs of neighbouring words (all repetitions of a word
are one feature) and runs of four bytes. A document is the mean of its features' vectors; softmax over two
outputs gives the probability of label 1. Training is numpy on a bounded sample of labelled rows; its features
are made in tasks. As output layer and mean are linear, scoring needs one number per feature, not a vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.llm.tokens import Texts, give_back, mixed, pieces

#: log2 of the buckets of each kind of feature.
BUCKET_BITS = 17
CHARS = 4


def _buckets(values: np.ndarray, kind: int) -> np.ndarray:
    bits = values.dtype.itemsize * 8
    return (values >> values.dtype.type(bits - BUCKET_BITS)).astype(np.int32) + np.int32(kind << BUCKET_BITS)


def features(texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of each kind of feature, and the bounds of each row in them."""
    words, bounds = texts.hashes(), texts.bounds
    out = [(_buckets(words, 0), bounds)]
    first = np.ones(len(words), dtype=bool)
    first[bounds[:-1][texts.counts > 0]] = False  # a row's first word ends no pair
    second = np.flatnonzero(first)
    pair = mixed(words[second - 1] * np.uint64(3) + words[second] * np.uint64(5))
    pair[words[second - 1] == words[second]] = np.uint64(1) << np.uint64(63)
    out.append((_buckets(pair, 1), np.searchsorted(second, bounds)))
    data, offsets = texts.data, texts.offsets
    count = max(0, len(data) - CHARS + 1)
    run = np.zeros(count, dtype=np.uint32)
    for j in range(CHARS):
        run <<= np.uint32(8)
        run |= data[j : j + count]
    run *= np.uint32(0x9E3779B1)
    inside = np.ones(count, dtype=bool)
    for cut in range(1, CHARS):  # a run may not reach over the end of its row
        at = offsets[1:] - cut
        inside[at[(at >= 0) & (at < count)]] = False
    places = np.flatnonzero(inside)
    out.append((_buckets(run[places], 2), np.searchsorted(places, offsets)))
    return out


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in as few bytes each as the largest needs; the reader tells the width from the length."""
    width = np.min_scalar_type(int(counts.max(initial=0))).itemsize
    return counts.astype(f"<u{width}")


def _rows(found: list[tuple[np.ndarray, np.ndarray]], row: int) -> np.ndarray:
    return np.concatenate([buckets[bounds[row] : bounds[row + 1]] for buckets, bounds in found])


@dataclass
class Model:
    #: by feature, what it adds to the margin of label 1 over label 0
    margins: np.ndarray
    bias: float


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], dim: int, epochs: int, rate: float, batch: int) -> Model:
    """rows: label, feature buckets and how often each occurs."""
    rng = np.random.default_rng(7)
    size = 3 << BUCKET_BITS
    vectors = np.empty((dim, size), dtype=np.float32)
    for k in range(dim):
        vectors[k] = rng.uniform(-1, 1, size) / dim
    output, bias = np.zeros((dim, 2)), np.zeros(2)
    rows = [row for row in rows if len(row[1])]
    steps, total = 0, max(1, epochs * -(-len(rows) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            part = [rows[i] for i in order[at : at + batch]]
            index = np.concatenate([x[1] for x in part])
            weight = np.concatenate([x[2] / x[2].sum() for x in part]).astype(np.float32)
            cuts = np.cumsum([0] + [len(x[1]) for x in part])[:-1]
            hidden = np.stack([np.add.reduceat(vectors[k][index] * weight, cuts) for k in range(dim)], axis=1)
            logits = hidden @ output + bias
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(part)), [x[0] for x in part]] -= 1
            step = rate * (1 - steps / total)
            back = chance @ output.T
            output -= step * hidden.T @ chance / len(part)
            bias -= step * chance.mean(axis=0)
            owner = np.repeat(np.arange(len(part)), [len(x[1]) for x in part])
            for k in range(dim):
                np.add.at(vectors[k], index, (-step * back[:, k].astype(np.float32))[owner] * weight)
            steps += 1
    margins = (output[:, 1] - output[:, 0]).astype(np.float32) @ vectors
    return Model(margins, float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int):
    """Features of a bounded sample of labelled documents: the labelled ids with the smallest hashes."""
    chosen = (
        labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for first, end, part in pieces(batch.column(1)):
                found = features(part)
                unique = [np.unique(_rows(found, i), return_counts=True) for i in range(part.rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.array([x[0].astype("<i4").tobytes() for x in unique], pa.binary()),
                        pa.array([_narrow(x[1]).tobytes() for x in unique], pa.binary()),
                    ],
                    ["label", "buckets", "counts"],
                )
            give_back()

    joined = texts.join(F.broadcast(chosen), "id").select("label", "text")
    table = joined.mapInArrow(run, "label int, buckets binary, counts binary").toArrow()
    order = pc.sort_indices(table, sort_keys=[("buckets", "ascending"), ("label", "ascending")])
    label, buckets, counts = table.columns
    out = []
    for i in order.to_pylist():  # views of what arrived, no copies
        found = np.frombuffer(buckets[i].as_buffer(), "<i4")
        often = counts[i].as_buffer()
        out.append((label[i].as_py(), found, np.frombuffer(often, f"<u{often.size // max(1, len(found)) or 1}")))
    return out


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability of label 1 as a further column (null texts count as empty; replaces a column of that name)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.margins, model.bias))

    @F.arrow_udf("double")
    def chance(column: pa.Array) -> pa.Array:
        margins, bias = sent.value
        out = np.full(len(column), bias)
        for first, end, texts in pieces(column):
            total, count = np.zeros(texts.rows), np.zeros(texts.rows)
            for buckets, bounds in features(texts):
                sums = np.concatenate([[0.0], np.cumsum(margins[buckets], dtype=np.float64)])
                total += sums[bounds[1:]] - sums[bounds[:-1]]
                count += np.diff(bounds)
            out[first:end] += total / np.maximum(count, 1)
        give_back()
        return pa.array(1 / (1 + np.exp(-np.clip(out, -500, 500))))

    return docs.withColumn(name, chance(F.col(text_col)))


def held_out(id_col: str | Column, folds: int = 5) -> Column:
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = 3000,
    dim: int = 8,
    epochs: int = 8,
    rate: float = 8.0,
    batch: int = 16,
) -> Model:
    """Learn from at most ``sample_rows`` labelled rows (the bound of what the driver sees).

    Labels other than 0 and 1, and null ids, are left out; of several labels of an id the largest counts, and
    repeated documents count as often as they come. Without labelled rows every score is 0.5.
    """
    model = train(training_rows(docs, labels, id_col, text_col, label_col, sample_rows), dim, epochs, rate, batch)
    give_back()
    return model
