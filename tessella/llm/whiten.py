"""Whitening of embeddings by an incremental eigendecomposition.

Entries become integers (256 to the unit, rounded down); each distinct vector counts once, so copies weigh nothing.
Every task keeps the eigenvalues and eigenvectors of the scatter about the mean of what it has read. A further vector is a
rank-one update of it, a multiple of the centred vector times itself: components of the vector that are zero and
eigenvalues that are equal are deflated, the secular equation gives the other eigenvalues between the old ones, all at
once, and eigenvectors follow from components recomputed from the roots, so that they stay orthogonal. Spectra are
joined, ``FAN_IN`` at a time, by as many rank-one updates as they have eigenvalues, and one for the distance of their means.
At last a Rayleigh-Ritz step over all vectors, again in tasks with sums of one small matrix, removes what the updates have
lost: the covariance in the basis found, its own eigenvectors, and the basis turned by them.

A task holds a matrix of the dimension's square; the driver gets that matrix, sums for each dimension and nothing else.

Defined cases: vectors that are null, empty, of another length than most (of equally common lengths the longer), or that
hold null or non-finite entries take no part; rows without an id stay; entries beyond the range of long integers are cut to it; a
deviation beyond that range is null; a component without variance has ``explained`` 0 and ``whitened`` null, and no part in
``identity_error``, which is null without any; of fewer dimensions than components all are returned; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize

SCALE, COMPONENTS = 256, 4
#: Distinct vectors of one task's spectrum, and spectra that one task joins.
PER_SPECTRUM, FAN_IN = 4096, 16
EPS = np.finfo(float).eps
STATE = "part int, n double, mean array<double>, roots array<double>, basis array<double>"


def _secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(weights / (poles - x))``, poles ascending and apart, weights positive: for each root the number of the pole
    that it is measured from, and its distance from it.

    Root ``i`` lies between poles ``i`` and ``i + 1``. Each step replaces the poles on either side by one with the same value and slope
    (the last root has none above) and halves the interval where that leads outside."""
    n = len(poles)
    gaps = np.append(np.diff(poles), weights.sum())
    middle = (poles + gaps / 2)[:, None]
    high = np.append(1 + (weights / (poles - middle)).sum(1) < 0, False)[:n]
    high[-1] = False
    origin = np.arange(n) + high
    shifted = poles - poles[origin][:, None]  # row i: all poles seen from root i's origin
    low, top = np.where(high, -gaps / 2, 0.0), np.where(high, 0.0, gaps)
    top[:-1] = np.where(high, 0.0, gaps / 2)[:-1]
    left = np.tri(n)
    at, below = (low + top) / 2, shifted[np.arange(n), np.arange(n)]
    above = np.append(shifted[np.arange(n - 1), np.arange(1, n)], np.inf)
    for _ in range(80):
        away = shifted - at[:, None]
        terms = weights / away
        slopes = terms / away
        total, psi, dpsi = terms.sum(1), np.einsum("ij,ij->i", terms, left), np.einsum("ij,ij->i", slopes, left)
        phi, dphi = total - psi, slopes.sum(1) - dpsi
        f = 1 + total
        low, top = np.where(f <= 0, at, low), np.where(f >= 0, at, top)
        done = (np.abs(f) <= 4 * EPS * (1 + np.abs(psi) + np.abs(phi)) * n) | (top - low <= 4 * EPS * np.abs(at))
        if done.all():
            break
        da, db = below - at, np.where(np.isinf(above), 0.0, above - at)
        c = f - da * dpsi - db * dphi
        a, b = (da + db) * f - da * db * (dpsi + dphi), da * db * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a > 0, 2 * b / (a + root), (a - root) / (2 * c))
        r = 1 + psi[-1] - da[-1] * dpsi[-1]
        step[-1] = da[-1] + da[-1] ** 2 * dpsi[-1] / r if r > 0 else np.nan
        new = at + step
        at = np.where(done, at, np.where((new > low) & (new < top), new, (low + top) / 2))
    return origin, at


def rank_one(roots: np.ndarray, basis: np.ndarray, vector: np.ndarray, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors (columns) after adding ``factor * vector * vector'``, factor not negative."""
    z = (basis.T @ vector) * np.sqrt(factor)
    size = z @ z
    scale = max(np.abs(roots).max(initial=0.0), size)
    if not size > 0:
        return roots, basis
    roots, basis = roots.copy(), basis.copy()
    least = 8 * EPS * scale
    # eigenvalues that are equal, or nearly so: turn their plane until one of the two has no component
    live = np.flatnonzero(np.abs(z) * np.sqrt(scale) > least)
    kept: list[int] = []
    close = live[np.flatnonzero(np.diff(roots[live]) <= least)] if len(live) > 1 else live[:0]
    if len(close):
        for i in live.tolist():
            j = kept[-1] if kept else -1
            if j >= 0 and (roots[i] - roots[j]) * abs(z[i] * z[j]) <= least * (z[i] ** 2 + z[j] ** 2):
                r = np.hypot(z[i], z[j])
                c, s = z[i] / r, z[j] / r
                basis[:, [j, i]] = basis[:, [j, i]] @ np.array([[c, s], [-s, c]])
                roots[j], roots[i] = c * c * roots[j] + s * s * roots[i], s * s * roots[j] + c * c * roots[i]
                z[i], z[j] = r, 0.0
                kept[-1] = i
            else:
                kept.append(i)
        live = np.array(kept)
        live = live[np.argsort(roots[live], kind="stable")]
    if len(live):
        poles, part = roots[live], z[live]
        origin, away = _secular_roots(poles, part**2)
        gaps = (poles - poles[origin][:, None]) - away[:, None]  # row k: poles less root k
        # components for which the roots found are exact
        apart = poles[None, :] - poles[:, None]
        np.fill_diagonal(apart, 1.0)
        ratio = -gaps / np.where(np.eye(len(live), dtype=bool), 1.0, apart.T)
        exact = np.sqrt(np.abs(np.prod(ratio, axis=0))) * np.sign(part)
        turned = exact / gaps
        turned /= np.sqrt((turned * turned).sum(1))[:, None]
        basis[:, live] = basis[:, live] @ turned.T
        roots[live] = poles[origin] + away
    order = np.argsort(roots, kind="stable")
    return roots[order], basis[:, order]


class Spectrum:
    """Number, mean and scatter (as eigenvalues and eigenvectors) of vectors."""

    def __init__(self, dimension: int) -> None:
        self.n, self.mean = 0.0, np.zeros(dimension)
        self.roots, self.basis = np.zeros(dimension), np.eye(dimension)

    def add(self, x: np.ndarray) -> None:
        if self.n:
            self.roots, self.basis = rank_one(self.roots, self.basis, x - self.mean, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + (x - self.mean) / self.n

    def join(self, other: Spectrum) -> None:
        if other.n:
            for root, vector in zip(other.roots, other.basis.T):
                if root > 0:
                    self.roots, self.basis = rank_one(self.roots, self.basis, vector, root)
            if self.n:
                self.roots, self.basis = rank_one(self.roots, self.basis, other.mean - self.mean, self.n * other.n / (self.n + other.n))
            self.n += other.n
            self.mean = self.mean + (other.mean - self.mean) * (other.n / self.n)

    def row(self, part: int) -> tuple:
        return part, self.n, self.mean, self.roots, self.basis.ravel()

    @classmethod
    def of(cls, row: tuple) -> Spectrum:
        s = cls(len(row.mean))
        s.n, s.mean, s.roots = row.n, np.array(row.mean), np.array(row.roots)
        s.basis = np.array(row.basis).reshape(len(s.mean), -1)
        return s


class Whitening(NamedTuple):
    n: int
    sums: list[int]
    #: Eigenvalues of the covariance, falling, and eigenvectors as columns; all of them.
    variances: np.ndarray
    vectors: np.ndarray
    identity_error: float | None

    @property
    def explained(self) -> np.ndarray:
        total = self.variances.sum()
        return self.variances / total if total > 0 else self.variances

    @property
    def positive(self) -> np.ndarray:
        return self.variances > len(self.sums) * EPS * self.variances.max(initial=0.0)


def integer_vectors(rows: DataFrame, vector_col: str, keep: list[str]) -> tuple[DataFrame, int]:
    """``keep`` and ``x`` of the rows that take part, and their dimension."""
    x = rows.select(*[rows[c] for c in keep], rows[vector_col].cast("array<double>").alias("_v"))
    fits = F.forall("_v", lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    x = x.filter(F.coalesce((F.size("_v") > 0) & fits, F.lit(False)))
    lengths = x.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths.d if lengths else 0
    return x.filter(F.size("_v") == d).select(*keep, F.transform("_v", lambda c: F.floor(c * SCALE)).alias("x")), d


def matrix_of(batch: pa.RecordBatch, column: str, d: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number and sums for each dimension; halves of 32 bits are summed apart, so that none overflows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = matrix_of(batch, "x", d)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    rows = fit.mapInArrow(run, "i int, n long, high long, low long").groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).orderBy("i").collect()
    return (rows[0].n, [(r.high << 32) + r.low for r in rows]) if rows else (0, [0] * d)


def _summed(fit: DataFrame, size: int, of) -> np.ndarray:
    """Sum over all batches of the ``size`` numbers that ``of`` makes of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += of(batch).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "v"])

    out = np.zeros(size)
    for r in fit.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out


def spectra(fit: DataFrame, n: int, d: int) -> DataFrame:
    """The spectrum (``STATE``) of each share of ``fit``."""
    parts = max(1, -(-n // PER_SPECTRUM))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        s = Spectrum(d)
        for batch in batches:
            for x in matrix_of(batch, "x", d).astype(float):
                s.add(x)
        if s.n:
            yield pa.RecordBatch.from_pandas(pd.DataFrame([s.row(0)], columns=["part", "n", "mean", "roots", "basis"]).astype({"part": "int32"}), preserve_index=False)

    rows = fit.repartition(parts, F.xxhash64("x")).mapInArrow(run, STATE)
    return rows.withColumn("part", F.spark_partition_id())


def joined(rows: DataFrame, fan_in: int = FAN_IN) -> Spectrum | None:
    """One spectrum from those of all shares."""
    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for row in pdf.sort_values("part").itertuples():
            s = Spectrum.of(row)
            if whole is None:
                whole = s
            else:
                whole.join(s)
        return pd.DataFrame([whole.row(int(key[0]))], columns=["part", "n", "mean", "roots", "basis"])

    rows = materialize(rows, "spectra")
    while rows.count() > 1:
        after = materialize(rows.withColumn("to", F.floor(F.col("part") / fan_in).cast("int")).groupBy("to").applyInPandas(join, STATE), "spectra")
        drop_table(rows)
        rows = after
    last = rows.first()
    return Spectrum.of(last) if last else None


def fit_whitening(fit: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """Whitening of the distinct integer vectors ``x`` (a written table, as four passes read it)."""
    n, sums = _exact_sums(fit, d)
    first = joined(spectra(fit, n, d)) if n else None
    if first is None:
        return Whitening(0, sums, np.zeros(d), np.eye(d), None)
    mean = np.array([s / n for s in sums])
    basis = np.linalg.qr(first.basis[:, ::-1])[0]

    def in_basis(batch: pa.RecordBatch) -> np.ndarray:
        y = (matrix_of(batch, "x", d) - mean) @ basis
        return y.T @ y

    ritz = _summed(fit, d * d, in_basis).reshape(d, d) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, vectors = np.maximum(values[::-1], 0.0), (basis @ turn)[:, ::-1]
    found = Whitening(n, sums, values, vectors, None)
    lead = np.flatnonzero(found.positive[:components])
    k = len(lead)
    if not k:
        return found
    axes = vectors[:, lead] / np.sqrt(values[lead])

    def products(batch: pa.RecordBatch) -> np.ndarray:
        w = (matrix_of(batch, "x", d) - mean) @ axes
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    total = _summed(fit, k + k * k, products) / n
    covariance = total[k:].reshape(k, k) - np.outer(total[:k], total[:k])
    return found._replace(identity_error=float(np.abs(covariance - np.eye(k)).max()))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error`` for each row that takes part and each component."""
    vectors, d = integer_vectors(rows, vector_col, [id_col])
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not d:
        return rows.sparkSession.createDataFrame([], schema)
    fit = materialize(vectors.select("x").distinct(), "distinct_vectors")
    model = fit_whitening(fit, d, components)
    k = min(components, d)
    mean = np.array([s / model.n for s in model.sums])
    scale = np.where(model.positive[:k], np.sqrt(model.variances[:k]), np.nan)
    explained, positive = model.explained[:k], model.positive[:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch, "x", d)
            m = len(x)
            with np.errstate(divide="ignore", invalid="ignore"):
                w = ((x - mean) @ model.vectors[:, :k]) / scale
            each = [np.repeat(np.arange(m), k), np.tile(np.arange(1, k + 1, dtype=np.int32), m)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(each[0])), pa.array(each[1]), pa.array(np.full(m * k, model.n)), pa.array(np.repeat(deviations(x, model.n, model.sums), k), pa.int64()),
                pa.array(w.ravel(), mask=np.tile(~positive, m)), pa.array(np.tile(np.where(positive, explained, 0.0), m)), pa.array([model.identity_error] * (m * k), pa.float64())],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, schema)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sums of the squares of ``n * x - sums``, exact; None for those beyond 63 bits."""
    most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) * n + max(map(abs, sums), default=0)
    if most * most * max(1, len(sums)) < 1 << 62:
        away = x * n - np.array(sums, np.int64)
        return (away * away).sum(1).astype(object)
    out = np.empty(len(x), object)
    for i, row in enumerate(x.tolist()):
        total = sum((n * c - s) ** 2 for c, s in zip(row, sums))
        out[i] = total if total < 1 << 63 else None
    return out
