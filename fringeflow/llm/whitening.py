"""Whitening of vectors by the leading components of their covariance, which is never formed.

Each pass over the table multiplies the centred covariance by a block of vectors; block Lanczos on the driver keeps a basis of dimension x block columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

COMPONENTS = 32
#: Columns of a Lanczos block: a pass over the table each.
BLOCK_COLUMNS = 16
#: Residual, relative to the largest eigenvalue, at which a component counts as found; and the eigenvalue below which there is none to divide by.
TOLERANCE, FLAT = 1e-14, 1e-10
_LONG = 2**63 - 1
#: Entries beyond are held at this, so that an entry is a long.
_MOST = 2**62


def longs(batch: pa.RecordBatch, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and x of a batch's usable vectors (vec_id, embedding): floor(64 c) + 1000000 as longs. Vectors that are null, empty, hold null or non-finite
    entries, or have another length than ``dimension`` are not usable."""
    lists = batch.column(1)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    ok = (lengths > 0) if dimension is None else (lengths == dimension)
    rows = np.flatnonzero(ok)
    if not len(rows):
        return rows, np.empty((0, dimension or 0), np.int64)
    flat = lists.take(pa.array(rows)).flatten().cast(pa.float64())
    good = np.isfinite(flat.to_numpy(zero_copy_only=False))  # a null entry is NaN here
    if dimension is None:
        starts = np.cumsum(lengths[rows]) - lengths[rows]
        rows = rows[np.logical_and.reduceat(good, starts)]
        return rows, lengths[rows]
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, dimension)
    keep = good.reshape(-1, dimension).all(axis=1)
    return rows[keep], np.clip(np.floor(64 * values[keep]), -_MOST, _MOST).astype(np.int64) + 1_000_000


@dataclass(frozen=True)
class Fit:
    """n vectors and their exact sums; a centred entry is (x - whole) - part, where whole is near the mean, so that no digits are lost."""

    n: int
    sums: tuple[int, ...]

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        whole = [round_half(s, self.n) for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2 of each row, exact."""
        whole, _ = self.centre()
        rest = np.array([s - int(w) * self.n for s, w in zip(self.sums, whole)], np.int64)
        d = x - whole
        most = int(np.abs(d).max(initial=0)) * self.n + int(np.abs(rest).max(initial=0))
        if most**2 * self.dimension <= _LONG:
            return ((d * self.n - rest) ** 2).sum(axis=1).tolist()
        return [sum((int(a) * self.n - int(b)) ** 2 for a, b in zip(row, rest)) for row in d]


def round_half(s: int, n: int) -> int:
    return (2 * s + n) // (2 * n)


def _vectors(df: DataFrame) -> DataFrame:
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _dimension(vectors: DataFrame) -> int | None:
    """The most frequent length of a usable vector, the longer of equals; None without any."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(longs(batch)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["length", "n"])

    most = vectors.mapInArrow(lengths, "length long, n long").groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    return most and most["length"]


def fit(vectors: DataFrame) -> Fit | None:
    """Count and exact sums of the usable vectors (vec_id, embedding) of the most frequent length; sums beyond a long raise ArithmeticError."""
    dimension = _dimension(vectors)
    if dimension is None:
        return None

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dimension
        for batch in batches:
            x = longs(batch, dimension)[1] - 1_000_000
            n += len(x)
            # halves of 32 bits can't overflow in a batch
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + b for t, h, b in zip(total, high, low)]
        if n:
            parts = [[n] * dimension, [t >> 32 for t in total], [t & 0xFFFFFFFF for t in total]]
            yield pa.RecordBatch.from_arrays([pa.array(range(dimension), pa.int64()), *[pa.array(p, pa.int64()) for p in parts]], ["j", "n", "high", "low"])

    got = vectors.mapInArrow(sums, "j long, n long, high long, low long").groupBy("j").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).collect()
    n = got[0]["n"]
    total = [(r["high"] << 32) + r["low"] + 1_000_000 * n for r in sorted(got, key=lambda r: r["j"])]
    if max(map(abs, total)) > _LONG:
        raise ArithmeticError("a sum of entries is beyond a long")
    return Fit(n, tuple(total))


def times_covariance(vectors: DataFrame, f: Fit) -> Callable[[np.ndarray], np.ndarray]:
    """v -> V v for blocks v (dimension x columns), a pass over the table each; what a task sends is one row a dimension, summed by dimension."""

    def multiply(block: np.ndarray) -> np.ndarray:
        whole, part = f.centre()
        names = [f"y{k}" for k in range(block.shape[1])]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros(block.shape), False
            for batch in batches:
                x = longs(batch, f.dimension)[1]
                if len(x):
                    c = (x - whole) - part
                    total += c.T @ (c @ block)
                    seen = True
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(range(f.dimension), pa.int64()), *map(pa.array, total.T)], ["j", *names])

        summed = vectors.mapInArrow(partial, "j long, " + ", ".join(f"{c} double" for c in names)).groupBy("j").agg(*[F.sum(c).alias(c) for c in names])
        out = np.zeros(block.shape)
        for r in summed.collect():
            out[r["j"]] = [r[c] for c in names]
        return out / f.n

    return multiply


def _orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, scale: float) -> np.ndarray:
    """``block`` orthonormal to itself and to ``basis``, reorthogonalised in full. A column that has nothing left, a breakdown, is started anew at random, as
    long as the space has room."""
    out = basis
    for v in block.T:
        if out.shape[1] == len(v):
            break
        size = scale
        for _ in range(8):
            for _ in range(3):
                v = v - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if left > 1e-10 * size and left > 0:
                break
            v = rng.normal(size=len(v))
            size = np.linalg.norm(v)
        v = v / np.linalg.norm(v)
        v = v - out @ (out.T @ v)
        out = np.column_stack([out, v / np.linalg.norm(v)])
    return out[:, basis.shape[1] :]


def lanczos(multiply: Callable[[np.ndarray], np.ndarray], dimension: int, wanted: int, columns: int = BLOCK_COLUMNS, tolerance: float = TOLERANCE, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a symmetric matrix given by its products with blocks.

    The basis grows by a block of ``columns`` a product until the residuals of all wanted pairs are below ``tolerance`` times the largest eigenvalue, or below
    a hundred times that and no longer falling (rounding), or it fills the space, where they are exact. What is kept is basis and products, so residuals are those of the matrix itself and not of a recurrence.
    """
    rng, wanted, before = np.random.default_rng(seed), min(wanted, dimension), math.inf
    basis, products = np.empty((dimension, 0)), np.empty((dimension, 0))
    block = _orthonormal(rng.normal(size=(dimension, min(columns, dimension))), basis, rng, 1.0)
    while True:
        product = multiply(block)
        basis, products = np.column_stack([basis, block]), np.column_stack([products, product])
        small = basis.T @ products
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:wanted], turn[:, ::-1][:, :wanted]
        vectors = basis @ turn
        if basis.shape[1] == dimension:
            return values, vectors
        residuals = np.linalg.norm(products @ turn - vectors * values, axis=0)
        worst = float(residuals.max()) / max(float(values[0]), 1e-300)
        if basis.shape[1] > wanted and (worst <= tolerance or worst <= 100 * tolerance and worst > before / 2):
            return values, vectors
        before = worst
        block = _orthonormal(product, basis, rng, max(float(np.linalg.norm(product, axis=0).max()), 1e-300))


@dataclass(frozen=True)
class Whitening:
    """Components (dimension x components), their eigenvalues and shares of the variance."""

    fit: Fit
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        whole, part = self.fit.centre()
        return ((x - whole) - part) @ (self.vectors / np.sqrt(self.values))


def learn(vectors: DataFrame, components: int = COMPONENTS, columns: int = BLOCK_COLUMNS) -> Whitening | None:
    """Components of the usable vectors, at most ``components``: as many as have an eigenvalue above FLAT times the largest. None without usable vectors."""
    f = fit(vectors)
    if f is None:
        return None

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(sum(f.deviations(longs(batch, f.dimension)[1])) for batch in batches)
        yield pa.RecordBatch.from_arrays([pa.array([str(total)])], ["total"])

    # sums of a task can be beyond a long: they are added as decimals
    deviation = vectors.mapInArrow(squares, "total string").agg(F.sum(F.col("total").cast("decimal(38,0)"))).first()[0] or 0
    trace = float(deviation) / f.n**3
    if not trace:
        return Whitening(f, np.empty(0), np.empty((f.dimension, 0)), np.empty(0))
    values, found = lanczos(times_covariance(vectors, f), f.dimension, components, columns)
    good = values > FLAT * values[0]
    return Whitening(f, values[good], found[:, good], values[good] / trace)


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance, in one more pass, minus the identity."""
    names = [f"y{k}" for k in range(len(w.values))]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 + len(names), len(names)))
        for batch in batches:
            z = w.apply(longs(batch, w.fit.dimension)[1])
            total[0] += z.sum(axis=0)
            total[1:] += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), *map(pa.array, total.T)], ["j", *names])

    summed = vectors.mapInArrow(partial, "j long, " + ", ".join(f"{c} double" for c in names)).groupBy("j").agg(*[F.sum(c).alias(c) for c in names])
    total = np.zeros((1 + len(names), len(names)))
    for r in summed.collect():
        total[r["j"]] = [r[c] for c in names]
    mean = total[0] / w.fit.n
    return float(np.abs(total[1:] / w.fit.n - np.outer(mean, mean) - np.eye(len(names))).max())


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) of each usable vector of ``embeddings`` (vec_id, embedding) and component.

    Vectors are usable unless null, empty or with null or non-finite entries; those of another length than the most frequent one (the longer of equals) are
    left out too. Repeated rows count and come back as often as they are there; a null vec_id stays null; other columns are not looked at. Components end
    where eigenvalues are below FLAT times the largest, so fewer than ``components`` where the vectors span less: none for one vector, for equal ones and for
    an empty table. Equal eigenvalues give any basis of their space. Entries are held within 2^62 and deviations within a long; beyond, sums raise.
    """
    small_batches(embeddings.sparkSession)
    vectors = _vectors(embeddings)
    w = learn(vectors, components)
    if w is None or not len(w.values):
        return embeddings.sparkSession.createDataFrame([], _RESULT)
    error, k = identity_error(vectors, w), len(w.values)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = longs(batch, w.fit.dimension)
            if len(at):
                times = lambda values: pa.array(np.repeat(values, k))
                ids = batch.column(0).take(pa.array(np.repeat(at, k)))
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), times(np.full(len(at), w.fit.n)), times(np.array([min(e, _LONG) for e in w.fit.deviations(x)], np.int64)), pa.array(w.apply(x).ravel()), pa.array(np.tile(w.explained, len(at))), times(np.full(len(at), error))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(rows, _RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
