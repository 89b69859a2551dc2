"""Whitening of embeddings onto their leading components, by Chebyshev-filtered subspace iteration.

Each entry ``c`` counts as the integer ``floor(1024 c) + 100000``, so counts and sums are exact. The vectors
are packed once into blocks of integers in the shared folder. One pass over the blocks multiplies a narrow
matrix ``Q`` by the covariance, centred before multiplying: every task sums its blocks, ``SLOTS`` tasks sum
those, and the driver adds up ``SLOTS`` matrices of the size of ``Q``. A round applies a Chebyshev polynomial
of the covariance to ``Q`` (one pass for each degree of its three-term recurrence), which damps the spectrum
below the smallest Ritz value of the block, then orthonormalises by QR and takes Ritz vectors. Where that
spectrum begins is estimated by Lanczos steps of one probe vector that travels with the first passes. Rounds go
on until the residual of every wanted pair has come down to rounding; a residual above ``CERTIFIED`` raises.

Odd input: rows whose vector is null, empty or holds a null or non-finite entry are dropped; vectors of
unlike lengths, and entries of 2**40 or more, raise ``ValueError``. Rows without id stay, repeated rows count
each and get the same numbers. No vector gives no row. Components of no variance (fewer distinct vectors than
components, one vector, equal vectors) are left out, so there may be fewer than asked for, or none. Of equal
eigenvalues any orthonormal vectors are returned; their sign makes the entry of largest size positive. Very
long vectors make ``Q`` long, which has some 30 columns, and nothing else wide. Extra columns are not read; an
id named like a result raises ``ValueError``. ``deviation`` beyond 64 bits raises ``OverflowError``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsload.workspace import written

SCALE = 1024  # of an entry; the constant added to it moves no result, as all are centred
LARGEST = 2**50
BLOCK = 4096
SLOTS = 16
GUARD = 20  # columns beyond the wanted ones
DEGREE = 10
PROBE = 12  # Lanczos steps
PROBED_ROUNDS = 8  # after that nought is taken for the lower end
ROUNDS = 200
CERTIFIED = 1e-11  # largest residual over largest eigenvalue
ROUNDING = 1e-13  # no further round is made below
RANK = 1e-12  # eigenvalues under this share of the largest count as none

RESULTS = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def matrix_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows count, and their integers without the added constant, a row each."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    bad = np.r_[0, np.cumsum(~np.isfinite(values))]
    lengths = np.diff(offsets)
    kept = (bad[offsets[1:]] == bad[offsets[:-1]]) & (lengths > 0)
    if column.null_count:
        kept &= column.is_valid().to_numpy(zero_copy_only=False)
    if not kept.any():
        return kept, np.empty((0, 0), np.int64)
    dims = int(lengths[kept][0])
    if (lengths[kept] != dims).any():
        raise ValueError("vectors differ in length")
    flat = values[offsets[:-1][kept][:, None] + np.arange(dims)]
    scaled = np.floor(SCALE * flat)
    if np.abs(scaled).max() >= LARGEST:
        raise ValueError("entries of 2**40 or more are not accepted")
    return kept, scaled.astype(np.int64)


def packed(vectors: DataFrame, vector: str) -> DataFrame:
    """The vectors that count as blocks ``(m, dims, wide, sums, data)`` of integers, written."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column(0))[1]
            for at in range(0, len(x), BLOCK):
                block = x[at : at + BLOCK]
                wide = bool(np.abs(block).max() >= 2**31)
                sums = [int(s) for s in block.astype(object if wide else np.int64).sum(axis=0)]
                data = block.astype("<i8" if wide else "<i4").tobytes()
                row = [[len(block)], [block.shape[1]], [wide], [sums], [data]]
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["m", "dims", "wide", "sums", "data"]
                )

    as_double = vectors.select(F.col(f"`{vector}`").cast("array<double>"))
    return written(as_double.mapInArrow(pack, "m long, dims long, wide boolean, sums array<long>, data binary"), "packed")


def summed(blocks: DataFrame, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of the flat array ``make`` gives for the integers of one, in two levels."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for m, wide, data in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                part = make(np.frombuffer(data, "<i8" if wide else "<i4").reshape(m, -1))
                total = part if total is None else total + part
        if total is not None:
            slot = TaskContext.get().partitionId() % SLOTS
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()])], ["slot", "part"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column("part").to_pylist():
                total = np.frombuffer(data) if total is None else total + np.frombuffer(data)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["part"])

    parts = blocks.select("m", "wide", "data").mapInArrow(each, "slot int, part binary")
    rows = parts.repartition(SLOTS, "slot").mapInArrow(together, "part binary").collect()
    return np.sum([np.frombuffer(r["part"]) for r in rows], axis=0)


class Covariance:
    """The covariance of the packed vectors, known by its products; ``trace`` comes with the first one."""

    def __init__(self, blocks: DataFrame, n: int, sums: list[int]):
        self.blocks, self.n, self.dims = blocks, n, len(sums)
        self.mean = np.array([s / n for s in sums])
        self.trace = 0.0
        start = np.random.default_rng(7).standard_normal(self.dims)
        self.probes, self.diagonal, self.beside = [start / np.linalg.norm(start)], [], []

    def __matmul__(self, q: np.ndarray) -> np.ndarray:
        if len(self.diagonal) < min(PROBE, self.dims):
            image = self._times(np.c_[q, self.probes[-1]])
            self._probed(image[:, -1])
            return image[:, :-1]
        return self._times(q)

    def _probed(self, image: np.ndarray) -> None:
        """One Lanczos step, with full reorthogonalisation."""
        self.diagonal.append(float(self.probes[-1] @ image))
        for _ in range(2):
            image = image - sum(v * (v @ image) for v in self.probes)
        self.beside.append(float(np.linalg.norm(image)))
        self.probes.append(image / max(self.beside[-1], 1e-300))

    def low(self) -> float:
        """Estimate of the smallest eigenvalue, from below."""
        values, vectors = np.linalg.eigh(np.diag(self.diagonal) + np.diag(self.beside[:-1], 1) + np.diag(self.beside[:-1], -1))
        return max(0.0, float(values[0] - abs(self.beside[-1] * vectors[-1, 0])))

    def _times(self, q: np.ndarray) -> np.ndarray:
        mean = self.mean

        def make(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return np.r_[(centred.T @ (centred @ q)).ravel(), np.einsum("ij,ij->", centred, centred)]

        flat = summed(self.blocks, make) / self.n
        self.trace = float(flat[-1])
        return flat[:-1].reshape(q.shape)


def rotated(q: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values of the space of ``q`` by falling size, Ritz vectors and their images."""
    small = q.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1]
    return values[order], q @ turn[:, order], image @ turn[:, order]


def filtered(cov: Covariance, q: np.ndarray, image: np.ndarray, low: float, cut: float) -> np.ndarray:
    """``q`` under the Chebyshev polynomial that is small between ``low`` and ``cut``; ``image`` is its product."""
    centre, half = (cut + low) / 2, (cut - low) / 2
    before, now = q, (image - centre * q) / half
    for _ in range(DEGREE - 1):
        before, now = now, 2 * (cov @ now - centre * now) / half - before
        size = np.linalg.norm(now, axis=0)  # columns may grow by many orders; both terms shrink alike
        before, now = before / size, now / size
    return now


def leading(cov: Covariance, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues and their unit vectors, each pair certified by its residual."""
    width = min(cov.dims, wanted + GUARD)
    q = np.eye(cov.dims) if width == cov.dims else np.random.default_rng(11).standard_normal((cov.dims, width))
    q = np.linalg.qr(q)[0]
    best, still = np.inf, 0
    for turn in range(ROUNDS):
        values, q, image = rotated(q, cov @ q)
        top = max(float(values[0]), 0.0)
        if top == 0.0:
            return values[:0], q[:, :0]
        residual = np.linalg.norm(image - q * values, axis=0)[:wanted].max() / top
        still = 0 if residual < best / 2 else still + 1
        if residual <= ROUNDING or residual <= CERTIFIED and (still or width == cov.dims):
            break
        best = min(best, residual)
        cut = max(float(values[-1]), RANK * top)
        low = min(cov.low(), 0.95 * cut) if turn < PROBED_ROUNDS and len(cov.diagonal) >= PROBE else 0.0
        q = np.linalg.qr(filtered(cov, q, image, low, cut))[0]
    else:
        raise ArithmeticError(f"residual {best:.1e} of the components stays above {CERTIFIED:.0e}")
    real = values[:wanted] > RANK * top
    values, vectors = values[:wanted][real], q[:, :wanted][:, real]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values, vectors * sign


def identity_error(cov: Covariance, turn: np.ndarray) -> float:
    """Largest entry by which the covariance of the whitened vectors differs from the identity."""
    mean, k = cov.mean, turn.shape[1]
    centre = summed(cov.blocks, lambda x: ((x - mean) @ turn).sum(axis=0)) / cov.n

    def make(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ turn - centre
        return (z.T @ z).ravel()

    return float(np.abs(summed(cov.blocks, make).reshape(k, k) / cov.n - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Exact sums of squares of ``n x - sums`` for each row."""
    bound = n * int(np.abs(x).max()) + max(abs(s) for s in sums)
    if bound * bound * x.shape[1] < 2**63:
        moved = x * n - np.array(sums)
        return np.einsum("ij,ij->i", moved, moved)
    exact = ((x.astype(object) * n - np.array(sums, dtype=object)) ** 2).sum(axis=1)
    if max(exact) >= 2**63:
        raise OverflowError("a deviation does not fit 64 bits")
    return exact.astype(np.int64)


def whitened(vectors: DataFrame, doc_id: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """For every vector that counts and every component a row ``(id, component, n, deviation, whitened, explained, identity_error)``."""
    if doc_id in RESULTS:
        raise ValueError(f"the id is named like a result: {doc_id}")
    spark, key = vectors.sparkSession, vectors.schema[doc_id]
    schema = (
        f"`{doc_id}` {key.dataType.simpleString()}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )
    blocks = packed(vectors, vector)
    size = blocks.agg(F.sum("m").alias("n"), F.min("dims").alias("low"), F.max("dims").alias("high")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    if size["low"] != size["high"]:
        raise ValueError("vectors differ in length")
    at = blocks.select(F.posexplode("sums")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s"))
    n, sums = size["n"], [int(r["s"]) for r in at.orderBy("pos").collect()]  # one row for each dimension
    cov = Covariance(blocks, n, sums)
    values, axes = leading(cov, components)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    turn, shares = axes / np.sqrt(values), values / cov.trace
    error, mean = identity_error(cov, turn), cov.mean

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = matrix_of(batch.column(1))
            m = len(x)
            if not m:
                continue
            ids = batch.column(0).filter(pa.array(kept)).take(pa.array(np.repeat(np.arange(m), k)))
            columns = [
                ids,
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)),
                pa.array(np.repeat(deviations(x, n, sums), k)),
                pa.array(((x - mean) @ turn).ravel()),
                pa.array(np.tile(shares, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [doc_id, *RESULTS])

    named = vectors.select(f"`{doc_id}`", F.col(f"`{vector}`").cast("array<double>"))
    return named.mapInArrow(project, schema)
