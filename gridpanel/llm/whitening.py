"""Whitening of embeddings by spectral divide and conquer.

Vectors become integers, so sums and products are exact: partial sums of Arrow batches add up as decimals, in any order, to one mean and one covariance. The
covariance has the size of a vector squared, whatever the number of rows. It is split by QR-based dynamically weighted Halley (QDWH) iterations: the polar
factor of the matrix less a shift is +1 on the eigenvectors above the shift and -1 on those below, half its sum with the identity is the projector on the
former, and a basis of its range and of the rest splits the matrix into two smaller ones, down to single components. The components go to all tasks,
which project their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.session import written

SCALE, OFFSET = 64, 1_000_000  # an entry c counts as floor(64 * c) + 1000000
EXACT = 1 << 53  # integers that doubles hold exactly
NEGLIGIBLE = 1e-13  # of the largest eigenvalue: directions below hold no variance


# ---- spectral divide and conquer ---------------------------------------------------------------------------------------------


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QDWH; eigenvalues that are zero to rounding take either sign."""
    norm = np.linalg.norm(a, 2)
    n = len(a)
    if norm == 0:
        return np.eye(n)
    x = a / norm
    low = max(np.finfo(float).eps / 4, 0.9 / max(np.linalg.cond(x, 1), 1.0) if np.linalg.matrix_rank(x) == n else 0.0)
    for _ in range(12):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack((np.sqrt(wc) * x, np.eye(n))))
        following = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        following = (following + following.T) / 2
        change = np.abs(following - x).max()
        x = following
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if abs(1 - low) < 1e-15 and change < 1e-8:
            break
    # one Newton-Schulz step takes off what rounding left
    return 1.5 * x - 0.5 * x @ (x.T @ x)


def _split(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span the eigenvectors above a shift, and k; None if no shift parts the eigenvalues."""
    n = len(a)
    middle = np.trace(a) / n
    spread = np.abs(a - middle * np.eye(n)).sum(1).max()
    if spread <= 8 * n * np.finfo(float).eps * max(abs(middle), spread):
        return None
    shift, step = float(np.median(np.diag(a))), spread
    for _ in range(60):
        u = polar_factor(a - shift * np.eye(n))
        projector = (u + np.eye(n)) / 2
        k = round(np.trace(projector))
        if 0 < k < n:
            # the widest columns of the projector, then one more turn, span its range
            order = np.argsort(-np.einsum("ij,ij->j", projector, projector), kind="stable")
            q, _ = np.linalg.qr(np.hstack((projector[:, order[:k]], (np.eye(n) - projector)[:, order[k:]])))
            for _ in range(2):
                q, _ = np.linalg.qr(np.hstack((projector @ q[:, :k], q[:, k:] - projector @ q[:, k:])))
            if np.abs(q[:, :k].T @ a @ q[:, k:]).max() <= 1e-10 * spread + n * np.finfo(float).eps * abs(middle):
                return q, k
        # all on one side, or an eigenvalue on the shift: move it
        step /= 2
        shift += step if k == n else -step if k == 0 else step * 0.01
    return None


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, by recursive splits of invariant subspaces."""
    basis = np.eye(len(a))
    pending, values, vectors = [(a, basis)] if len(a) else [], [], []
    while pending:
        block, space = pending.pop()
        split = _split(block) if len(block) > 1 else None
        if split is None:  # one component, or components of one eigenvalue
            for j in range(len(block)):
                values.append(block[j, j])
                vectors.append(space[:, j])
            continue
        q, k = split
        for part in (q[:, :k], q[:, k:]):
            inner = part.T @ block @ part
            pending.append(((inner + inner.T) / 2, space @ part))
    if not values:
        return np.zeros(0), np.zeros((0, 0))
    order = np.argsort(-np.array(values), kind="stable")
    return _refined(a, np.array(vectors).T[:, order])


def _refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step against the rounding of the splits, in extended precision: orthonormal columns, and no product of two of them through ``a``."""
    wide, x = a.astype(np.longdouble), x.astype(np.longdouble)
    for _ in range(2):
        off = np.eye(len(a)) - x.T @ x
        inner = x.T @ wide @ x
        values = np.diag(inner) / (1 - np.diag(off))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= 1e-12 * np.abs(values).max()
        correction = np.where(near, off / 2, (inner + values[None, :] * off) / np.where(near, 1, gap))
        x = x + x @ correction
    for _ in range(2):
        x = x + x @ (np.eye(len(a)) - x.T @ x) / 2  # the closest orthonormal columns
    values = np.einsum("ij,ij->j", x, wide @ x)
    order = np.argsort(-values, kind="stable")
    return values[order].astype(float), x[:, order].astype(float)


# ---- sums over all rows ------------------------------------------------------------------------------------------------------


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id and x (array of long) of the rows whose vector is whole: not null, no null or non-finite entry, and of the length that most vectors have.

    Of equally frequent lengths the larger one counts; empty vectors are dropped.
    """
    bad = F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == F.lit(float("inf"))))
    whole = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(~F.coalesce(bad, F.lit(False)))
    sizes = whole.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("c")).agg(F.max_by("d", F.struct("c", "d")).alias("most"))
    x = F.transform("embedding", lambda e: F.floor(F.lit(float(SCALE)) * e.cast("double")) + F.lit(OFFSET))
    most = sizes.first()["most"]  # one number
    return whole.where(F.size("embedding") == F.lit(most if most is not None else 0)).select("vec_id", x.alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _product_sums(centre: list[int]):
    """Exact sums of the products of all pairs of dimensions, less ``centre``; a row for each batch and dimension."""
    middle = np.array(centre, np.int64)
    d = len(middle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x")) - middle
            largest = int(np.abs(x).max())
            at_once = EXACT // max(largest * largest, 1)  # rows whose sums of products doubles hold exactly
            for i in range(0, len(x), max(1, min(at_once, len(x)))):
                part = x[i : i + max(1, at_once)]
                if at_once >= 1:
                    part = part.astype(float)
                    total += (part.T @ part).astype(np.int64).astype(object)
                else:
                    total += part.astype(object).T @ part.astype(object)
        rows, columns = np.triu_indices(d)
        values = [str(v) for v in total[rows, columns]]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(columns, pa.int32()), pa.array(values)], names=["i", "j", "s"])

    return run


def moments(x: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """Number of rows, sums of the dimensions, and the covariance (divisor n), rounded once from its exact value."""
    sums = x.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    found = sorted(sums.collect())  # a row for each dimension
    if not found:
        return 0, [], np.zeros((0, 0))
    n, s = found[0]["n"], [int(r["s"]) for r in found]
    centre = [v // n for v in s]
    products = x.select("x").mapInArrow(_product_sums(centre), "i int, j int, s string")
    products = products.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    rest = [v - n * c for v, c in zip(s, centre, strict=True)]  # the mean is the centre plus rest / n
    out = np.zeros((len(s), len(s)))
    for i, j, total in products.collect():  # one row for each pair of dimensions
        out[i, j] = out[j, i] = float(Fraction(n * int(total) - rest[i] * rest[j], n * n))
    return n, s, out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S, and the sums of its squares as exact integers."""
    high = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if high < 1 << 62:
        apart = n * x - np.array(sums, np.int64)
        if x.shape[1] * int(np.abs(apart).max(initial=0)) ** 2 < 1 << 63:
            return apart, (apart * apart).sum(1)
    apart = n * x.astype(object) - np.array(sums, object)
    return apart, (apart * apart).sum(1)


def _centred(apart: np.ndarray, n: int) -> np.ndarray:
    return (apart / n).astype(float) if apart.dtype == object else apart / n


def _whitened_sums(n: int, sums: list[int], weights: np.ndarray):
    """Sums and products of whitened values; a row for each pair of components, -1 for the sums."""
    k = weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = _centred(_deviations(_matrix(batch.column("x")), n, sums)[0], n) @ weights
                total += w.sum(0)
                products += w.T @ w
        rows, columns = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((rows, np.arange(k))), pa.int32()), pa.array(np.concatenate((columns, np.full(k, -1))), pa.int32()),
             pa.array(np.concatenate((products[rows, columns], total)))], names=["i", "j", "s"])

    return run


def _project(n: int, sums: list[int], weights: np.ndarray, explained: np.ndarray, error: float):
    k = weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.num_rows
            apart, squares = _deviations(_matrix(batch.column("x")), n, sums)
            w = _centred(apart, n) @ weights
            deviation = pa.array(squares.tolist(), pa.int64())  # raises where an exact square passes 64 bits
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                 deviation.take(each), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(embeddings: DataFrame, components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for every whole vector and each of the first ``components`` components.

    A row with a null vector, or one with null or non-finite entries, is dropped, as are empty vectors and those of another length than most have. Repeated
    rows and ids are rows like any other, a null vec_id stays, extra columns are ignored. Components without variance (below ``NEGLIGIBLE`` of the
    largest) have no whitened value and are left out; so a single row, equal rows only, or no row give no result rows. Components of one
    eigenvalue are any orthonormal basis of its space. A deviation beyond 64 bits is an error.
    """
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    x = written(integers(embeddings))
    n, sums, covariance = moments(x)
    values, vectors = eigen(covariance)
    kept = min(components, int((values > NEGLIGIBLE * values[0]).sum())) if len(values) and values[0] > 0 else 0
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not kept:
        return embeddings.sparkSession.createDataFrame([], schema)
    weights = vectors[:, :kept] / np.sqrt(values[:kept])
    checked = x.select("x").mapInArrow(_whitened_sums(n, sums, weights), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    found = {(r["i"], r["j"]): r["s"] / n for r in checked.collect()}  # one row for each pair of components
    error = max(abs(v - found[i, -1] * found[j, -1] - (i == j)) for (i, j), v in found.items() if j >= 0)
    return x.mapInArrow(_project(n, sums, weights, values[:kept] / np.trace(covariance), error), schema)
