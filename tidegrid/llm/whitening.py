"""Embedding whitening by matrix-free block subspace iteration.

Vectors lie on a lattice: an entry c becomes the integer floor(scale * c) + shift. One scan counts the vectors and sums their
entries exactly. Then every pass over the table multiplies the covariance with a block of orthonormal columns Q, as the sum over
centred rows of their transpose times (rows times Q), without ever forming the covariance; Q is found again by QR, and
Rayleigh-Ritz in its span gives eigenvalues, vectors and their residuals. The iteration ends when the residual of each of the
k components is at most TOLERANCE of the largest eigenvalue. A block that converges slowly is doubled, up to all dimensions, where one pass is exact. A last
pass measures the covariance of the whitened rows.

Rows are centred as (x - r) - (S - n r) / n with an integer r near the mean, so that a large shift costs no digit.

Defined results: a row whose vector is null, empty, of another length than most, or holds null or non-finite entries is left
out; repeated rows and rows without an id count and are returned like all others; with fewer dimensions than k there are as many components as dimensions. A
component without variance has no whitened values (null). ``deviation`` is null where it doesn't fit into a long. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import spread, table
from tidegrid.llm.vectors import matrix_of, summed, width_of

TOLERANCE = 1e-12
MOST_PASSES = 400
#: A block that needs more passes than this, as its residuals fall, is doubled.
PATIENCE = 8
#: An eigenvalue below this share of the largest is no variance.
NOTHING = 1e-13
#: Integers up to this are exact in sums and differences of a few.
WIDE = 1 << 62


def lattice(values: np.ndarray, scale: float, shift: int) -> np.ndarray:
    """floor(scale * c) + shift as 64-bit integers; what lies beyond them stays at their end."""
    return np.clip(np.floor(values * scale), -(2.0**61), 2.0**61).astype(np.int64) + shift


@dataclass
class Lattice:
    """How vectors are read: their column, length, scale, shift, and the integers that centre them."""

    width: int
    scale: float
    shift: int
    n: int = 0
    near: np.ndarray | None = None  # integers near the mean
    rest: np.ndarray | None = None  # S - n * near, Python integers

    def whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows, values = matrix_of(column, self.width)
        return rows, lattice(values, self.scale, self.shift)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near).astype(float) - np.array([r / self.n for r in self.rest])


def moments(df: DataFrame, vec_col: str, how: Lattice) -> Lattice:
    """The number of vectors and the exact sums of their entries, one row for each dimension and task."""
    width = how.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            _, x = how.whole(batch.column(0))
            n += len(x)
            # halves of 32 bits add up exactly in 64
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            total = [t + (int(h) << 32) + int(lo) for t, h, lo in zip(total, high, low, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*range(width), -1], pa.int32()), pa.array([str(v) for v in [*total, n]])], names=["i", "v"])

    found = df.select(vec_col).mapInArrow(run, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    sums = {row.i: int(row.v) for row in found}
    n = sums.pop(-1, 0)
    near = [round(sums[i] / n) for i in range(width)] if n else []
    return Lattice(width, how.scale, how.shift, n, np.array(near, np.int64), [sums[i] - n * near[i] for i in range(width)] if n else [])


def covariance_times(df: DataFrame, vec_col: str, how: Lattice) -> Callable[[np.ndarray], tuple[np.ndarray, float]]:
    """Q -> (covariance times Q, trace of the covariance), by one pass over the table."""

    def product(q: np.ndarray) -> tuple[np.ndarray, float]:
        def add(own: np.ndarray, batch: pa.RecordBatch) -> None:
            rows = how.centred(how.whole(batch.column(0))[1])
            own[:, :-1] += rows.T @ (rows @ q)
            own[:, -1] += (rows * rows).sum(axis=0)

        out = summed(df.select(vec_col), (how.width, q.shape[1] + 1), add) / how.n
        return out[:, :-1], float(out[:, -1].sum())

    return product


def subspace(product: Callable[[np.ndarray], tuple[np.ndarray, float]], width: int, k: int, block: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns, trace, residual norms) of the k leading components."""
    draw = np.random.default_rng(13)
    k, block = min(k, width), min(max(block, k), width)
    q = np.eye(width) if block == width else np.linalg.qr(draw.standard_normal((width, block)))[0]
    before = np.inf
    for _ in range(MOST_PASSES):
        y, trace = product(q)
        small = q.T @ y
        e, turn = np.linalg.eigh((small + small.T) / 2)
        e, turn = e[::-1], turn[:, ::-1]
        ritz, image = q @ turn, y @ turn
        residual = np.linalg.norm(image[:, :k] - ritz[:, :k] * e[:k], axis=0)
        worst = residual.max()
        if worst <= TOLERANCE * max(e[0], 0.0) or q.shape[1] == width:
            return e[:k], ritz[:, :k], trace, residual
        rate = worst / before  # 0 where there is nothing to compare with
        left = np.log(TOLERANCE * e[0] / worst) / np.log(rate) if 0 < rate < 1 else np.inf
        if rate > 0 and left > PATIENCE:
            more = min(width, 2 * q.shape[1]) - q.shape[1]
            image = np.concatenate([image, draw.standard_normal((width, more)) * e[0]], axis=1)
            worst = np.inf  # the next two residuals tell the new rate
        q, before = np.linalg.qr(image)[0], worst
    raise RuntimeError(f"no certificate after {MOST_PASSES} passes: residual {worst:.3g} of {e[0]:.3g}")


def identity_error(df: DataFrame, vec_col: str, how: Lattice, project: np.ndarray) -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity; null without a component."""
    m = project.shape[1]
    if not m:
        return None

    def add(own: np.ndarray, batch: pa.RecordBatch) -> None:
        z = how.centred(how.whole(batch.column(0))[1]) @ project
        own[:, :-1] += z.T @ z
        own[:, -1] += z.sum(axis=0)

    out = summed(df.select(vec_col), (m, m + 1), add) / how.n
    return float(np.abs(out[:, :-1] - np.outer(out[:, -1], out[:, -1]) - np.eye(m)).max())


def deviations(x: np.ndarray, how: Lattice) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 of each row, exactly."""
    off = x - how.near
    if not len(off):
        return []
    reach = how.n * max(int(np.abs(off).max()), 1) + max(abs(r) for r in how.rest)
    if how.width * reach * reach < WIDE:
        d = how.n * off - np.array(how.rest, np.int64)
        return (d * d).sum(axis=1).tolist()
    found = [sum((how.n * int(v) - r) ** 2 for v, r in zip(row, how.rest, strict=True)) for row in off]
    return [v if v < 1 << 63 else None for v in found]


@dataclass
class Whitening:
    """What whitens a table: its lattice, components (columns), their variances, shares of the trace, and the certificates."""

    how: Lattice
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    residuals: np.ndarray
    error: float | None

    @property
    def project(self) -> np.ndarray:
        """Columns that map centred rows to whitened values; NaN for a component without variance."""
        good = self.variances > NOTHING * max(self.variances.max(initial=0.0), 0.0)
        return self.components / np.sqrt(np.where(good, self.variances, np.nan))


def fit(df: DataFrame, vec_col: str, k: int = 32, scale: float = 64.0, shift: int = 1_000_000, block: int | None = None) -> Whitening | None:
    """The whitening of a table's vectors by its k leading components; None without vectors."""
    width = width_of(df, vec_col)
    how = moments(df, vec_col, Lattice(width, scale, shift)) if width else None
    if how is None or not how.n:
        return None
    e, components, trace, residuals = subspace(covariance_times(df, vec_col, how), width, k, block or 2 * k)
    found = Whitening(how, components, e, e / trace if trace > 0 else np.full(len(e), np.nan), residuals, None)
    project = found.project
    found.error = identity_error(df, vec_col, how, project[:, np.isfinite(project).all(axis=0)])
    return found


def whitened(df: DataFrame, model: Whitening, id_col: str, vec_col: str) -> DataFrame:
    """One row for each vector and component."""
    how, project = model.how, model.project
    k = project.shape[1]
    layout = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
    explained = np.where(np.isfinite(model.explained), model.explained, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = how.whole(batch.column(1))
            z = how.centred(x) @ project
            each = np.repeat(np.arange(len(x)), k)
            n = len(each)
            columns = (
                batch.column(0).take(pa.array(rows[each])),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(n, how.n)),
                pa.array(deviations(x, how), pa.int64()).take(pa.array(each)),
                pa.array(z.ravel(), mask=~np.isfinite(z.ravel())),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(n, np.nan if model.error is None else model.error), mask=np.full(n, model.error is None)),
            )
            yield pa.RecordBatch.from_arrays(list(columns), schema=layout)

    return df.select(F.col(id_col).cast("long").alias("vec_id"), vec_col).mapInArrow(run, SCHEMA)


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    model = fit(vectors, "embedding")
    return spark.createDataFrame([], SCHEMA) if model is None else whitened(vectors, model, "vec_id", "embedding")
