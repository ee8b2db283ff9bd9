"""Embedding whitening: principal components by matrix-free block Lanczos over distributed passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dropped, saved

COMPONENTS = 16
#: Fixed-point form of an entry: SCALE steps to one, from OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Entries from here on have no exact fixed-point form; their rows are dropped like those that are not finite.
GREATEST = 2.0**46
#: Residual, in shares of the largest eigenvalue, from which a component counts as found; eigenvalues from which a direction counts.
RESIDUAL, RANK = 1e-13, 1e-12
LIMIT = 2**63


@dataclass
class Fit:
    """What the driver holds: sizes, sums and components, all as long as a vector; nothing as long as the table."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # dimensions x components, unit columns
    values: np.ndarray  # eigenvalues, falling
    trace: float
    passes: int
    identity_error: float = 0.0

    @property
    def base(self) -> np.ndarray:
        """Whole part of the mean."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What is left of each sum, under n."""
        return np.array([s % self.n for s in self.sums], np.int64)


def fixed_point(vectors: DataFrame) -> DataFrame:
    """``vec_id, x`` of the rows whose entries are all finite and that have the commonest length (of equally common ones the longest)."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < F.lit(GREATEST))), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(whole)
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    x = F.transform("v", lambda c: F.floor(c * SCALE) + OFFSET)
    return rows.where(F.size("v") == (size[0]["size"] if size else 0)).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _summed(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of a fixed number of doubles that ``of`` makes of a batch: partial sums in tasks, then by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column(0))).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "part"])

    rows = fit.select("x").mapInArrow(run, "at long, part double").groupBy("at").agg(F.sum("part").alias("part")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r.at] = r.part
    return out


def column_sums(fit: DataFrame) -> list[int]:
    """Exact sums of each place of ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                part = x.sum(0, dtype=np.int64) if np.abs(x).max() < 2**62 // len(x) else x.astype(object).sum(0)
                total = [a + int(b) for a, b in zip(total or [0] * len(part), part, strict=True)]
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], ["at", "part"])

    rows = fit.select("x").mapInArrow(run, "at int, part decimal(38,0)").groupBy("at").agg(F.sum("part").alias("part")).collect()
    return [int(r.part) for r in sorted(rows, key=lambda r: r.at)]


def _centred(fit: Fit) -> Callable[[np.ndarray], np.ndarray]:
    base, share = fit.base, fit.rest / fit.n
    return lambda x: (x - base).astype(np.float64) - share


def deviations(x: np.ndarray, fit: Fit) -> list[int | None]:
    """Exact sums of (n x - S)^2; null where one has no place in a long."""
    n, base, rest = fit.n, fit.base, fit.rest
    gap = x - base
    far = np.abs(gap).max(initial=0) + 1
    if float(far) * n < 2**31 and float(far * n) ** 2 * x.shape[1] < LIMIT:
        d = gap * n - rest
        return (d * d).sum(1).tolist()
    if float(far) * n < 2**62:
        d = gap * n - rest
        near = (d.astype(np.float64) ** 2).sum(1)
        exact = np.where(near < 2**62, (d * d).sum(1), 0).tolist()  # wraps only where it is not taken
        if near.max(initial=0) < 2**62:
            return exact
    whole = [sum((n * int(v) - s) ** 2 for v, s in zip(row, fit.sums, strict=True)) for row in x]
    return [w if w < LIMIT else None for w in whole]


def _orthonormal(block: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Unit columns orthogonal to the basis and each other, from a block; a direction that breaks down starts again at random."""
    out = []
    for col in block.T:
        q = np.column_stack([basis, *out]) if out else basis
        if q.shape[1] >= q.shape[0]:
            break
        size = 0.0
        for attempt in range(8):
            v = col if attempt == 0 else rng.standard_normal(len(col))
            least = scale * 1e-10 if attempt == 0 else 1e-6
            for _ in range(3):  # full reorthogonalisation, again and again
                v = v - q @ (q.T @ v)
            if (size := np.linalg.norm(v)) > least:
                v = v / size
                v = v - q @ (q.T @ v)
                out.append(v / np.linalg.norm(v))
                break
    return np.column_stack(out) if out else np.zeros((len(basis), 0))


def block_lanczos(apply: Callable[[np.ndarray], np.ndarray], size: int, wanted: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Largest eigenvalues, falling, their unit eigenvectors, and the passes it took, of a symmetric operator on blocks of columns.

    Each pass applies the operator to the newest block; its part outside the basis is the next block. It ends once the
    residuals of all wanted pairs are small, or the basis is the whole space. A block as wide as the components finds
    eigenvalues of that multiplicity.
    """
    rng = np.random.default_rng(12)
    wanted = min(wanted, size)
    basis, image = np.zeros((size, 0)), np.zeros((size, 0))
    block, passes = _orthonormal(rng.standard_normal((size, wanted)), basis, 0.0, rng), 0
    while True:
        got = apply(block)
        passes += 1
        basis, image = np.column_stack([basis, block]), np.column_stack([image, got])
        small = basis.T @ image
        values, y = np.linalg.eigh((small + small.T) / 2)
        values, y = values[::-1][:wanted], y[:, ::-1][:, :wanted]
        top = max(abs(values[0]), np.finfo(float).tiny)
        vectors = basis @ y
        residual = np.linalg.norm(image @ y - vectors * values, axis=0)
        if basis.shape[1] >= size or (basis.shape[1] > wanted and residual.max() <= RESIDUAL * top):
            return values, vectors / np.linalg.norm(vectors, axis=0), passes
        block = _orthonormal(got, basis, top, rng)
        if not block.shape[1]:
            return values, vectors / np.linalg.norm(vectors, axis=0), passes


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Components of the distinct vectors ``fit(x)``; none of an empty table."""
    n = fit.count()
    if not n:
        return None
    sums = column_sums(fit)
    out = Fit(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0, 0)
    centre = _centred(out)

    def apply(block: np.ndarray) -> np.ndarray:
        return _summed(fit, lambda x: (c := centre(x)).T @ (c @ block)).reshape(block.shape) / n

    # Shares are taken of the mean squared deviation, so no direction beyond the components is needed.
    out.trace = float(_summed(fit, lambda x: (centre(x) ** 2).sum(keepdims=True))[0]) / n
    if not out.trace:
        return out
    out.values, out.vectors, out.passes = block_lanczos(apply, len(sums), components)
    some = out.values > RANK * out.values[0]
    out.values, out.vectors = out.values[some], out.vectors[:, some]
    k, to = len(out.values), out.vectors / np.sqrt(out.values)

    def moments(x: np.ndarray) -> np.ndarray:
        z = centre(x) @ to
        return np.concatenate([(z.T @ z).ravel(), z.sum(0)])

    sums_of = _summed(fit, moments)
    mean = sums_of[k * k :] / n
    out.identity_error = float(np.abs(sums_of[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    return out


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    ``vectors(vec_id, embedding)`` are put in fixed point; their distinct forms are fitted, and every row is projected. The
    fit passes over the distinct vectors in tasks, and only blocks of sums as long as a vector come to the driver.

    Rows whose vector is null or empty, holds null or non-finite entries (or ones of 2^46 or more), or is not of the
    commonest length are dropped; zero vectors are not. Directions without spread (eigenvalues under 1e-12 of the largest)
    give no component, so a table of one distinct vector gives no rows, as an empty one does. Repeated rows each come
    back; a null id stays null. A deviation that no long can hold is null. Further columns are not read.
    """
    rows = saved(fixed_point(vectors))
    fit = saved(rows.select("x").distinct())
    found = fitted(fit, components)
    dropped(fit)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None or not len(found.values):
        return vectors.sparkSession.createDataFrame([], schema)
    sent = vectors.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = sent.value
        k, to, centre = len(fit.values), fit.vectors / np.sqrt(fit.values), _centred(fit)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x, m = _matrix(part.column(1)), part.num_rows
                ids = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                spread = pa.array(deviations(x, fit), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                cells = [np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, fit.n), spread, (centre(x) @ to).ravel(), np.tile(fit.values / fit.trace, m), np.full(m * k, fit.identity_error)]
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, cells)], [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(run, schema)
