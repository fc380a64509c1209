"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

With the rows of X centred, step k makes u_k from X v_k and v_(k+1) from X' u_k; both are orthogonalised against all
earlier ones. In these bases X is upper bidiagonal, and the singular values and right vectors of that small matrix give
deviations and components. Every u is X w for a short vector w that the driver knows, so the long vectors are never
stored: a task makes its rows' part of u and adds its rows' part of X' u at once, in one pass over the vectors. Products
of u with all earlier u are then products of short vectors (u_j . u = w_j . X' u).

The steps end when they span all dimensions, or earlier if the wanted values have converged and the variance outside
of the span is less than the least of them, so that no component (not even a repeated value) can have been missed.

What reaches the driver in a pass is one number per dimension, summed by Spark. Nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.llm.common import shared_table
from quadweave.llm.tokens import give_back

#: Components with less than this share of the largest variance are rounding errors and are left out.
LEAST_SHARE = 1e-11
#: Relative error at which a value counts as converged.
CONVERGED = 1e-14
#: Entries beyond this can't be told apart from their neighbours as doubles after scaling.
LARGEST = float(1 << 40)


@dataclass
class Whitening:
    """n vectors with sums per dimension; unit components (columns) and variances by falling variance; all variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0


def usable(vector: str) -> Column:
    """Neither null nor empty, all entries finite."""
    finite = "c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity')"
    return F.expr(f"size(`{vector}`) > 0 AND forall(`{vector}`, c -> {finite})")


def whole_numbers(vectors: DataFrame, *, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """(id, x): floor(scale * entry) + shift as longs, written once. Rows with null, empty or non-finite vectors go.

    If lengths differ, the most frequent one counts (of several the greatest) and rows of other lengths go as well. Finite
    entries beyond 2**40 are an error.
    """
    whole = f"floor({scale} * cast(c as double)) + {shift}L"
    x = F.expr(
        f"transform(`{vector_col}`, c -> CASE WHEN abs(c) <= {LARGEST} THEN {whole} "
        f"ELSE cast(raise_error('entry beyond {LARGEST:g}') as bigint) END)"
    )
    rows = shared_table(vectors.filter(usable(vector_col)).select(F.col(id_col).alias("id"), x.alias("x")), "vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    return rows.filter(F.size("x") == lengths[0].d) if len(lengths) > 1 else rows


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1)


def _summed(rows: DataFrame, function: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sum of function(x-vectors of a batch) over all rows: a row per task and place, summed by Spark."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = function(_matrix(batch, 0))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "value"])
        give_back()

    parts = rows.select("x").mapInArrow(run, f"at int, value {kind}")
    found = {r.at: r.value for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect()}
    return np.array([found[i] for i in range(len(found))], dtype=np.int64 if kind == "bigint" else np.float64)


def _centred(n: int, sums: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """x - S/n; the whole part of the mean is taken off exactly."""
    whole = np.array([int(s) // n for s in sums], dtype=np.int64)
    rest = np.array([(int(s) - n * int(m)) / n for s, m in zip(sums, whole, strict=True)])
    return lambda x: (x - whole).astype(np.float64) - rest


def bidiagonalise(
    product: Callable[[np.ndarray], np.ndarray], dimensions: int, total: float, wanted: int, seed: int = 11
) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, right singular vectors as columns) of X, at most ``wanted``, largest first.

    product(w) is X'Xw; total is the sum of squares of X.
    """
    rng = np.random.default_rng(seed)
    v, w, z = (np.zeros((dimensions, 0)) for _ in range(3))  # right vectors; u_j = X w_j; X' u_j
    alphas: list[float] = []
    betas: list[float] = []
    tiny = CONVERGED * np.sqrt(total)

    def against(basis: np.ndarray, vector: np.ndarray) -> np.ndarray:
        for _ in range(2):
            vector = vector - basis @ (basis.T @ vector)
        return vector

    def fresh() -> np.ndarray:
        vector = against(v, rng.standard_normal(dimensions))
        return vector / np.linalg.norm(vector)

    def solved() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        upper = np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1)
        left, values, right = np.linalg.svd(upper)
        return left, values, right

    new = fresh()
    while len(alphas) < dimensions:
        v = np.column_stack([v, new])
        short = new - betas[-1] * w[:, -1] if betas else new.copy()
        long = product(short)
        for _ in range(2):  # u against all earlier ones; anew from the rows if little of it is left
            size = float(short @ long)
            share = w.T @ long
            short, long = short - w @ share, long - z @ share
            if size - float(share @ share) > 0.5 * size or size <= tiny * tiny:
                break
            long = product(short)
        alpha = np.sqrt(max(0.0, float(short @ long)))
        if alpha > tiny:
            w, z = np.column_stack([w, short / alpha]), np.column_stack([z, long / alpha])
            rest = against(v, z[:, -1] - alpha * new)
        else:  # X v_k lies in the span of the earlier u
            alpha = 0.0
            w, z = (np.column_stack([x, np.zeros(dimensions)]) for x in (w, z))
            rest = np.zeros(dimensions)
        alphas.append(alpha)
        beta = float(np.linalg.norm(rest))
        if len(alphas) == dimensions:
            break
        left, values, _ = solved()
        outside = total - sum(a * a for a in alphas) - sum(b * b for b in betas)
        if len(alphas) >= wanted and outside < 0.99 * values[wanted - 1] ** 2:
            if np.all(beta * np.abs(left[-1, :wanted]) <= CONVERGED * values[0]):
                break
        if beta > tiny:
            betas.append(beta)
            new = rest / beta
        else:  # the span is invariant: go on in what is left
            betas.append(0.0)
            new = fresh()
    _, values, right = solved()
    return values[:wanted] ** 2, v @ right[:wanted].T


def fit_whitening(rows: DataFrame, components: int = 8) -> Whitening | None:
    """Fit on all rows (id, x) with vectors of longs of one length. None if there are no rows."""
    head = _summed(rows, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), "bigint")
    if not len(head):
        return None
    n, sums = int(head[0]), head[1:]
    centred = _centred(n, sums)

    def squares(x):
        y = centred(x)
        return (y * y).sum(axis=0)

    def product(w):
        def both(x):
            y = centred(x)
            return y.T @ (y @ w)

        return _summed(rows, both, "double")

    total = float(_summed(rows, squares, "double").sum())
    if total == 0:
        return Whitening(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    values, vectors = bidiagonalise(product, len(sums), total, min(components, len(sums)))
    kept = values > LEAST_SHARE * values[0]
    model = Whitening(n, sums, vectors[:, kept], values[kept] / n, total / n)
    model.identity_error = _identity_error(rows, model)
    return model


def _projected(model: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    centred, along = _centred(model.n, model.sums), model.components / np.sqrt(model.variances)
    return lambda x: centred(x) @ along


def _identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured on all rows."""
    projected, k = _projected(model), len(model.variances)
    mean = _summed(rows, lambda x: projected(x).sum(axis=0), "double") / model.n

    def moments(x):
        y = projected(x) - mean
        return (y.T @ y).ravel()

    return float(np.abs(_summed(rows, moments, "double").reshape(k, k) / model.n - np.eye(k)).max())


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of rows (id, x): a row per component.

    deviation is the sum of (n * x - S)**2, exact; one that a long can't hold is an error.
    """
    projected, n, sums = _projected(model), model.n, model.sums
    explained, identity_error, k = model.variances / model.trace if model.trace else model.variances, model.identity_error, len(model.variances)

    def run(batches):
        for batch in batches:
            x = _matrix(batch, 1)
            apart = n * x - sums
            if len(x) and (np.square(apart.astype(np.float64)).sum(axis=1) > 9.2e18).any():
                raise OverflowError("a deviation is too large for a long")
            deviation = np.square(apart).sum(axis=1)
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows), n, dtype=np.int64)),
                    pa.array(deviation[rows]),
                    pa.array(projected(x).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(rows), identity_error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )
        give_back()

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return rows.select("id", "x").mapInArrow(run, schema)


def whitened_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = 8,
    scale: int = 1024,
    shift: int = 100_000,
) -> DataFrame:
    """One row per usable vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Entries become the longs floor(scale * entry) + shift; see ``whole_numbers`` for the rows that go. All rows that stay are
    the fit list, repeated ones as often as they come. Null ids are kept. Components without variance are left out:
    equal vectors, or a single one, give no rows, and fewer than ``components`` where the vectors span less. An empty table
    gives no rows. Other columns are ignored.
    """
    rows = whole_numbers(vectors, id_col=id_col, vector_col=vector_col, scale=scale, shift=shift)
    model = fit_whitening(rows, components)
    if model is None or not len(model.variances):
        model = Whitening(1, np.zeros(1, np.int64), np.zeros((1, 0)), np.zeros(0), 0.0)
        rows = rows.limit(0)
    return whiten(rows, model).withColumnRenamed("id", id_col)
