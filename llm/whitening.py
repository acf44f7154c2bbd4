"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become whole numbers x = floor(SCALE * c) + SHIFT. The fit list is each distinct x vector
once, its rows centred by their exact mean. A Lanczos step is one pass over the fit list: tasks
multiply their rows with v (u = Xv) and add up u * x and u * u (the product of the transpose with u, and the norm of u), a row a
dimension a task, which Spark adds; the driver sees one vector of the embedding's width a step, never a row of the list.

Full reorthogonalisation keeps both bases orthogonal to working precision. New right vectors are made
orthogonal to the earlier ones directly. The left ones are as long as the fit list and are not stored: each is X times a
known vector, so that its product with an earlier u is that vector times that u's transpose product, which the driver has; the
part to take away goes into v before the pass. Where a basis is exhausted (repeated eigenvalues, spare dimensions) a new random direction
continues it. Steps end when the residuals of the wanted components are negligible, or with the last dimension; a second start beside
the components found then looks for copies of a repeated eigenvalue. The singular value decomposition of the small bidiagonal matrix gives components and deviations.

Rows are dropped if their vector is null or holds null or non-finite entries, or ones that are no long after scaling (over
LARGEST). Shorter vectors count as if their last entries were 0, up to the longest. A deviation beyond a long is null. There are as many
components as the covariance has nonzero eigenvalues, WANTED at most: none for one distinct vector, and an empty result then and for an
empty table. Rows that repeat or lack a vec_id give a result each; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise, read

SCALE, SHIFT = 64, 1_000_000
#: Largest entry by absolute value; beyond it sums of long numbers would not be safe.
LARGEST = 2.0**40
#: Components that are returned.
WANTED = 16
#: A residual or an eigenvalue is negligible below this share of the largest singular value or eigenvalue.
NEGLIGIBLE = 1e-13
#: Rows that numpy handles at once.
ROWS = 4096

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of vectors(vec_id, embedding) whose entries are all finite."""
    entry = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long"), entry.alias("e")).where(F.col("e").isNotNull())
    rows = rows.where(F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)))
    return rows.select("vec_id", F.transform("e", lambda c: (F.floor(c * SCALE) + SHIFT).cast("long")).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of x; missing last entries are those of 0."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy()[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    if len(size) and (size == width).all():
        return values.reshape(-1, width)
    out = np.full((len(size), width), SHIFT, np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], size)] = values
    return out


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, _matrix(part.column(part.schema.get_field_index("x")), width)


class Fit:
    """The distinct vectors, their number, sums and components."""

    def __init__(self, rows: DataFrame, wanted: int = WANTED) -> None:
        self.spark = rows.sparkSession
        self.width = rows.agg(F.max(F.size("x"))).first()[0] or 0
        tail = F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(self.width) - F.size("x"))
        self.table = materialise(rows.select(F.concat("x", tail).alias("x")).distinct())
        self.n, self.sums = self._sums()
        self.axes, self.values, self.trace = np.zeros((0, self.width)), np.zeros(0), 0.0
        if self.n > 1 and self.width:
            self._decompose(wanted)

    def _sums(self) -> tuple[int, list[int]]:
        """Exact: each task adds the entries' low and high halves apart, so that no sum leaves a long."""
        width = self.width

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, low, high = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
            for _, x in _blocks(batches, width):
                n, low, high = n + len(x), low + (x & 0xFFFFFFFF).sum(0), high + (x >> 32).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([n, *low]), pa.array([0, *high])], ["dim", "low", "high"])

        parts = self.table.mapInArrow(partial, "dim int, low long, high long").groupBy("dim").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high")])
        found = {r["dim"]: int(r["low"]) + (int(r["high"]) << 32) for r in parts.collect()}
        return found.pop(-1, 0), [found.get(i, 0) for i in range(width)]

    @property
    def centred(self):
        """Rows of x to x - S/n; whole parts are subtracted as whole numbers."""
        base, rest = np.array([v // self.n for v in self.sums], np.int64), np.array([v % self.n for v in self.sums]) / self.n
        return lambda x: (x - base).astype(float) - rest

    def _pass(self, kernel, size: int) -> np.ndarray:
        """The sum over the fit list of kernel(centred rows), a vector of `size` numbers."""
        width, centred = self.width, self.centred

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, any_ = np.zeros(size), False
            for _, x in _blocks(batches, width):
                total, any_ = total + kernel(centred(x)), True
            if any_:
                yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], ["dim", "s"])

        out = np.zeros(size)
        for r in self.table.mapInArrow(partial, "dim int, s double").groupBy("dim").agg(F.sum("s").alias("s")).collect():
            out[r["dim"]] = r["s"]
        return out

    def product(self, v: np.ndarray) -> tuple[float, np.ndarray]:
        """(u'u, X'u) of u = Xv."""

        def kernel(x: np.ndarray) -> np.ndarray:
            u = x @ v
            return np.concatenate(([u @ u], u @ x))

        found = self._pass(kernel, self.width + 1)
        return float(found[0]), found[1:]

    def _decompose(self, wanted: int) -> None:
        self.trace = float(self._pass(lambda x: np.array([(x * x).sum()]), 1)[0]) / self.n
        if not self.trace:
            return
        rng = np.random.default_rng(13)
        axes, s, whole = self._lanczos(np.zeros((0, self.width)), np.zeros(0), wanted, rng)
        axes, s = axes[:wanted], s[:wanted]
        while not whole:
            # a Krylov space holds one direction of a repeated eigenvalue: look beside the components for one as large
            more, t, whole = self._lanczos(axes, s, 1, rng)
            if not whole:
                more, t = more[:1], t[:1]
            last = whole or t[0] <= s[-1]
            order = np.argsort(-np.concatenate((s, t)), kind="stable")[:wanted]
            axes, s = np.vstack((axes, more))[order], np.concatenate((s, t))[order]
            if last:
                break
        keep = s**2 > s[0] ** 2 * NEGLIGIBLE * self.width
        self.axes, self.values = axes[keep], s[keep] ** 2 / self.n

    def _lanczos(self, axes: np.ndarray, s: np.ndarray, wanted: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, bool]:
        """Right singular vectors and singular values of the rows beside the given ones, and whether they are all there are.

        Ends once the first `wanted` have converged.
        """
        right = axes  # v, in rows
        source, back = axes / s[:, None], axes * s[:, None]  # u = X source, and X'u
        alphas, betas, beta = [], [], 0.0
        energy, known, largest = self.trace * self.n, float((s * s).sum()), float(s.max(initial=0))

        def new_direction() -> np.ndarray:
            v = rng.standard_normal(self.width)
            for _ in range(3):
                v -= right.T @ (right @ v)
                v /= np.linalg.norm(v)
            return v

        v = new_direction()
        while True:
            w = v - beta * source[-1] if alphas else v.copy()
            right = np.vstack((right, v))
            for _ in range(2):
                w -= source.T @ (back @ w)
            square, transposed = self.product(w)
            alpha = np.sqrt(square)
            largest = max(largest, alpha)
            if alpha <= NEGLIGIBLE * largest:  # the rows have nothing in this direction
                alpha, w, transposed = 0.0, np.zeros(self.width), np.zeros(self.width)
            alphas.append(alpha)
            source, back = np.vstack((source, w / (alpha or 1))), np.vstack((back, transposed / (alpha or 1)))
            r = back[-1].copy()
            for _ in range(2):
                r -= right.T @ (right @ r)
            beta = float(np.linalg.norm(r))
            p, t, qt = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
            whole = len(right) >= self.width or energy - known - (t * t).sum() <= NEGLIGIBLE * energy
            if whole or (len(t) >= wanted and (np.abs(beta * p[-1, :wanted]) <= NEGLIGIBLE * max(largest, t[0])).all()):
                return qt @ right[len(s) :], t, whole
            if beta <= NEGLIGIBLE * largest:
                v, beta = new_direction(), 0.0
            else:
                v = r / beta
            betas.append(beta)


def whiten(vectors: DataFrame, wanted: int = WANTED) -> DataFrame:
    """A row for each usable row of vectors(vec_id, embedding) and component, as in SCHEMA."""
    rows = scaled(vectors)
    fit = Fit(rows, wanted)
    n, k = fit.n, len(fit.values)
    if not k:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    weights = (fit.axes / np.sqrt(fit.values)[:, None]).T
    moments = fit._pass(lambda x: np.concatenate([(w := x @ weights).sum(0), (w.T @ w).ravel()]), k + k * k)
    mean = moments[:k] / n
    error = float(np.abs(moments[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    width, sums, centred = fit.width, fit.sums, fit.centred
    explained = fit.values / fit.trace
    base = np.array([v // n for v in sums], np.int64)
    rest = np.array([v % n for v in sums], np.int64)

    def deviations(x: np.ndarray) -> list[int | None]:
        """Sums of (n*x - S)^2, in longs where they surely fit, else in Python's numbers."""
        d = x - base
        if (n * (int(np.abs(d).max()) + 1)) ** 2 * width < 1 << 63:
            d = n * d - rest
            return (d * d).sum(1).tolist()
        d = n * d.astype(object) - rest.astype(object)
        return [v if v < 1 << 63 else None for v in (d * d).sum(1)]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, width):
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array((centred(x) @ weights).ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                [c.split()[0] for c in SCHEMA.split(", ")],
            )

    return rows.mapInArrow(projected, SCHEMA)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
