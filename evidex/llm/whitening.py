"""Embedding whitening: vectors projected on the principal components of their own covariance, to unit variance.

Entries become whole numbers first, x = floor(64 * c) + 1000000, so that sums over any number
of rows are exact and the mean doesn't depend on their order.  Two passes give the covariance:
one adds up the entries, a second the outer products of centred rows, one matrix product
a batch of rows.  Both are merged in a tree, as d + d * d numbers a partition; LAPACK's
symmetric solver takes the covariance apart on the driver, and the projection (d columns, 32 at
most) is broadcast.  A last pass measures how far the whitened rows are from unit covariance:
centred within each batch, and batches merged by what their means differ.

Cases: rows whose vector is null, empty or holds null, NaN or infinite entries take no part,
nor do those of another length than the most usual one (of equally usual ones the shorter) and
those with entries of 2 ** 55 or beyond, whose x a long can't hold.  Repeated rows count each,
ids may be null or repeat.  A component without variance can't be scaled: its ``whitened`` is
null and it does not count in ``identity_error``.  A deviation that a long can't hold is null.
An empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import table

SCALE, SHIFT = 64, 1_000_000
#: Entries from here on have no x.
TOO_LARGE = float(1 << 55)
COMPONENTS = 32
#: Rows of a matrix product.
BLOCK = 4096
_LONG = 1 << 62


def usable(vec: str, dim: int | None = None) -> Column:
    """Whether a vector takes part; ``dim`` is the usual length."""
    v = F.col(vec)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < TOO_LARGE))
    return fine if dim is None else fine & (F.size(v) == dim)


def whole(column: pa.Array) -> np.ndarray:
    """x of each entry, as (rows, d) longs."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(len(column), -1) + SHIFT


def exact(x: np.ndarray, times: int) -> np.ndarray:
    """``x`` in a type that holds ``times`` times its entries, summed or differed."""
    return x if 2 * times * int(np.abs(x).max(initial=1)) < _LONG else x.astype(object)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly."""
    x = exact(x, n)
    return n * x - np.array(sums, x.dtype)


def squared(deviation: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exactly; None beyond a long."""
    d = deviation
    if d.dtype != object and d.shape[1] * int(np.abs(d).max(initial=1)) ** 2 >= _LONG:
        d = d.astype(object)
    return [s if s < 1 << 63 else None for s in (d * d).sum(axis=1).tolist()]


class Moments:
    """Rows, their mean and the sum of outer products of what they differ from it; parts are merged exactly as if seen at once."""

    def __init__(self, x: np.ndarray):
        self.n, self.mean = len(x), x.mean(axis=0)
        centred = x - self.mean
        self.products = centred.T @ centred

    def merge(self, other: Moments) -> Moments:
        n, apart = self.n + other.n, other.mean - self.mean
        self.products += other.products + np.outer(apart, apart) * (self.n * other.n / n)
        self.mean += apart * (other.n / n)
        self.n = n
        return self


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            yield b.slice(at, BLOCK)


class Whitening:
    """A fitted projection: ``n`` rows with sums ``sums``, eigenvalues falling, one column a component."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray):
        self.n, self.sums, self.covariance = n, sums, covariance
        values, axes = np.linalg.eigh(covariance)
        values, axes = values[::-1][:COMPONENTS], axes[:, ::-1][:, :COMPONENTS]
        largest = np.abs(axes).argmax(axis=0)
        axes = axes * np.where(axes[largest, np.arange(axes.shape[1])] < 0, -1.0, 1.0)  # the largest entry is positive
        total = float(np.trace(covariance))
        noise = len(covariance) * np.finfo(float).eps * max(float(values[0]), 0.0)
        self.varies = values > noise
        self.explained = np.maximum(values, 0.0) / total if total > 0 else np.zeros(len(values))
        self.projection = np.where(self.varies, axes / np.sqrt(np.where(self.varies, values, 1.0)), 0.0)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact deviations of rows, and x - S / n."""
        d = deviations(x, self.n, self.sums)
        return d, (d / self.n).astype(np.float64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x)[1] @ self.projection


def fit(rows: DataFrame, vec_col: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors of ``rows`` (all of one length); None if there are none."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for b in _blocks(batches):
            x = whole(b.column(0))
            n, total = n + len(x), total + exact(x, len(x)).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "s": [[str(s) for s in total]]})

    vectors = rows.select(vec_col)
    add = lambda a, b: b if a is None else a if b is None else (a[0] + b[0], [s + t for s, t in zip(a[1], b[1], strict=True)])
    found = vectors.mapInArrow(sums, "n bigint, s array<string>").rdd.map(lambda r: (r["n"], [int(s) for s in r["s"]])).treeAggregate(None, add, add)
    if found is None:
        return None
    n, total = found

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = None
        for b in _blocks(batches):
            centred = (deviations(whole(b.column(0)), n, total) / n).astype(np.float64)
            part = centred.T @ centred
            added = part if added is None else added + part
        if added is not None:
            yield pa.RecordBatch.from_pydict({"p": [added.tobytes()]})

    plus = lambda a, b: b if a is None else a if b is None else a + b
    product = vectors.mapInArrow(products, "p binary").rdd.map(lambda r: np.frombuffer(r["p"]).reshape(len(total), -1)).treeAggregate(None, plus, plus)
    return Whitening(n, total, product / n)


def identity_error(rows: DataFrame, model: Whitening, vec_col: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured on all of them."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for b in _blocks(batches):
            part = Moments(shared.value.whitened(whole(b.column(0))))
            seen = part if seen is None else seen.merge(part)
        if seen is not None:
            yield pa.RecordBatch.from_pydict({"n": [seen.n], "m": [seen.mean.tobytes()], "p": [seen.products.tobytes()]})

    def as_moments(r) -> Moments:
        out = Moments.__new__(Moments)
        out.n, out.mean = r["n"], np.frombuffer(r["m"]).copy()
        out.products = np.frombuffer(r["p"]).reshape(len(out.mean), -1).copy()
        return out

    merge = lambda a, b: b if a is None else a if b is None else a.merge(b)
    found = rows.select(vec_col).mapInArrow(moments, "n bigint, m binary, p binary").rdd.map(as_moments).treeAggregate(None, merge, merge)
    kept = np.flatnonzero(model.varies)
    covariance = (found.products / found.n)[np.ix_(kept, kept)]
    return float(np.abs(covariance - np.eye(len(kept))).max(initial=0.0))


def usual_length(rows: DataFrame, vec_col: str = "embedding") -> int | None:
    found = rows.where(usable(vec_col)).groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return None if found is None else found["d"]


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): one row for each usable vector and component."""
    out = f"{id_col} bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    dim = usual_length(rows, vec_col)
    if dim is None:
        return rows.sparkSession.createDataFrame([], out)
    kept = rows.where(usable(vec_col, dim)).select(F.col(id_col).cast("bigint").alias(id_col), vec_col)
    model = fit(kept, vec_col)
    error = identity_error(kept, model, vec_col)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.varies)
        for b in _blocks(batches):
            d, centred = m.centred(whole(b.column(1)))
            rows = len(d)
            place = pa.array(np.repeat(np.arange(rows), k))
            each = lambda values: np.tile(values, rows)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(place), pa.array(each(np.arange(1, k + 1, dtype=np.int32))), pa.array(np.full(rows * k, m.n)), pa.array(squared(d), pa.int64()).take(place),
                    pa.array((centred @ m.projection).reshape(-1), mask=each(~m.varies)), pa.array(each(m.explained)), pa.array(np.full(rows * k, error)),
                ],
                names=[c.split()[0] for c in out.split(", ")],
            )

    return kept.mapInArrow(project, out)


def op13(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
