"""Whitening of vectors from exact whole-number covariances, counted on bit planes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted

#: Steps a unit of a component is cut into, and what is added so that numbers are positive.
UNIT, SHIFT = 64, 1_000_000
#: Entries of vectors that are packed into planes at once.
SLAB = 1 << 21
#: Numbers of this size and more do not fit a long beside their differences.
LARGEST = float(1 << 61)
#: Bits of the lower part in which sums too large for a long are passed on.
LIMB = 62


# ---- bit planes ------------------------------------------------------------


def bit_planes(values: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of the columns of `values` (rows x dimensions, none negative): a plane is one bit of one dimension, packed across rows into words of 64.

    widths: bits of each dimension. Returns the planes (planes x words), in
    order of dimension and bit, with the dimension and the bit of each.
    """
    rows = len(values)
    dims = np.repeat(np.arange(len(widths)), widths)
    bits = np.concatenate([np.arange(w) for w in widths]) if len(dims) else np.zeros(0, np.int64)
    planes = np.zeros((len(dims), -(-rows // 64) * 8), np.uint8)
    for p, (d, b) in enumerate(zip(dims, bits, strict=True)):
        packed = np.packbits((values[:, d] >> b) & 1 != 0)
        planes[p, : len(packed)] = packed
    return planes.view(np.uint64), dims, bits


def cross_products(planes: np.ndarray, dims: np.ndarray, bits: np.ndarray, n_dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products of every two dimensions i <= j, and sums of every dimension, exactly.

    The sum of x_i * x_j is that of 2 ** (b + c) times the ones that plane b of
    i and plane c of j have in common. Numbers are longs where they cannot
    overflow and whole numbers of Python otherwise.
    """
    width = int(bits.max()) + 1 if len(bits) else 0
    kind = np.int64 if 2 * width + int(planes.shape[1] * 64).bit_length() < 62 else object
    weight = np.array([1 << int(b) for b in bits], kind)
    products, sums = np.zeros((n_dims, n_dims), kind), np.zeros(n_dims, kind)
    first = np.searchsorted(dims, dims)  # the first plane of the same dimension
    for p, (d, b) in enumerate(zip(dims, bits, strict=True)):
        ones = np.bitwise_count(planes[p] & planes[first[p] :]).sum(1, dtype=np.int64).astype(kind) * weight[first[p] :]
        starts = np.flatnonzero(np.diff(dims[first[p] :], prepend=-1))
        products[d, dims[first[p] :][starts]] += np.add.reduceat(ones, starts) * (1 << int(b))
        sums[d] += int(np.bitwise_count(planes[p]).sum(dtype=np.int64)) * (1 << int(b))
    return products, sums


# ---- vectors ---------------------------------------------------------------


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, rows of the batch, numbers of their vectors as whole numbers) of vectors that take part, at most SLAB entries at once."""
    column = batch.column(1)
    entries = column.flatten()
    bad = np.flatnonzero(~np.isfinite(entries.fill_null(np.nan).to_numpy(zero_copy_only=False)) | ~(np.abs(entries.fill_null(np.nan).to_numpy(zero_copy_only=False)) * UNIT < LARGEST))
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    ok = sizes > 0
    ok[np.searchsorted(ends, bad, side="right")] = False
    values = entries.fill_null(0.0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[ok]):
        rows = np.flatnonzero(ok & (sizes == size))
        step = max(1, SLAB // int(size))
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            places = (ends[part] - size)[:, None] + np.arange(size)[None, :]
            yield int(size), part, np.floor(values[places] * UNIT).astype(np.int64) + SHIFT


@dataclass
class Fit:
    """What the fit list tells: n vectors, the least number of each dimension, sums of what is over it, and the components.

    components: a column each, of unit length, by falling eigenvalue; the entry of largest size is positive.
    """

    n: int
    low: np.ndarray
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def flat(self) -> np.ndarray:
        """Components along which vectors do not vary, up to rounding."""
        return self.values <= len(self.values) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)


def _limits(vectors: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """Commonest number of dimensions (of equals the largest), how many vectors have it, and least and largest number of each dimension."""

    def list_limits(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for size, _, x in _vectors(batch):
                own = found.setdefault(size, [0, x[0].copy(), x[0].copy()])
                own[0] += len(x)
                np.minimum(own[1], x.min(0), out=own[1])
                np.maximum(own[2], x.max(0), out=own[2])
        for size, (n, low, high) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, size)), pa.array(np.arange(size)), pa.array(np.full(size, n)), pa.array(low), pa.array(high)], ["size", "dim", "n", "low", "high"])

    limits = vectors.mapInArrow(list_limits, "size long, dim long, n long, low long, high long")
    limits = limits.groupBy("size", "dim").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    top = limits.filter("dim = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if top is None:
        return None
    rows = limits.filter(F.col("size") == top["size"]).orderBy("dim").collect()
    return int(top["size"]), int(top["n"]), np.array([r["low"] for r in rows]), np.array([r["high"] for r in rows])


def fit_whitening(vectors: DataFrame) -> Fit | None:
    """The exact covariance of the vectors and its eigenvectors; None without a vector.

    vectors: id, vec. Each task packs its numbers, less the dimension's least
    one, into bit planes and counts on these; the tasks' sums are added up by
    Spark, and only a matrix of dimensions by dimensions reaches the driver.
    There n * sum(x_i * x_j) - S_i * S_j is taken in whole numbers, so that
    nothing is rounded before the division by n squared.
    """
    limits = _limits(vectors)
    if limits is None:
        return None
    size, n, low, high = limits
    widths = np.array([int(h - v).bit_length() for h, v in zip(high.tolist(), low.tolist(), strict=True)])
    upper = np.triu_indices(size)

    def count(batches):
        products, sums, any_row = np.zeros((size, size), object), np.zeros(size, object), False
        for batch in batches:
            for d, _, x in _vectors(batch):
                if d == size:
                    a, b = cross_products(*bit_planes(x - low, widths), size)
                    products, sums, any_row = products + a, sums + b, True
        if any_row:
            found = [int(v) for v in [*products[upper], *sums]]
            i, j = np.concatenate([upper[0], np.arange(size)]), np.concatenate([upper[1], np.full(size, -1)])
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array([str(v >> LIMB) for v in found]), pa.array([v & ((1 << LIMB) - 1) for v in found])], ["i", "j", "high", "low"])

    parts = vectors.mapInArrow(count, "i long, j long, high string, low long")
    wide = "decimal(38,0)"
    totals = parts.groupBy("i", "j").agg(F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast("decimal(19,0)")).alias("low"))
    got = {(r["i"], r["j"]): (int(r["high"]) << LIMB) + int(r["low"]) for r in totals.collect()}
    sums = [got[i, -1] for i in range(size)]
    covariance = np.zeros((size, size))
    for i, j in zip(*upper, strict=True):
        covariance[i, j] = covariance[j, i] = float(Fraction(n * got[i, j] - sums[i] * sums[j], n * n))
    values, components = np.linalg.eigh(covariance)
    values, components = values[::-1], components[:, ::-1]
    largest = np.abs(components).argmax(0)
    components = components * np.where(components[largest, np.arange(size)] < 0, -1.0, 1.0)
    return Fit(n, low, sums, values, components, float(np.trace(covariance)))


def _whitened(fit: Fit, x: np.ndarray, k: int) -> np.ndarray:
    """Rows projected on the first k components, at unit variance; NaN along flat ones."""
    centred = (x - fit.low).astype(float) - np.array([float(Fraction(s, fit.n)) for s in fit.sums])
    scale = np.where(fit.flat[:k], np.nan, np.sqrt(np.maximum(fit.values[:k], 0)))
    return centred @ fit.components[:, :k] / scale


def _deviations(fit: Fit, x: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n * x - S) ** 2 of each row, exactly; null with over 38 digits."""
    y = x - fit.low
    most = max(fit.n * int(y.max(initial=0)), *fit.sums, 1)
    kind = np.int64 if 2 * most.bit_length() + len(fit.low).bit_length() < 63 else object
    apart = y.astype(kind) * fit.n - np.array(fit.sums, kind)
    total = (apart * apart).sum(1)
    if kind is np.int64:
        return pa.array(total).cast(pa.decimal128(38, 0))
    return pa.array([int(v) if int(v) < 10**38 else None for v in total], pa.decimal128(38, 0))


def _identity_error(vectors: DataFrame, fit: Fit, k: int) -> float | None:
    """Largest entry, in size, of the whitened vectors' covariance minus the identity, over components that are not flat.

    A first pass gives the means, a second the products of what is left
    without them. Each task passes on a row for every two components.
    """
    used = np.flatnonzero(~fit.flat[:k])
    if not len(used):
        return None
    size, upper = len(fit.low), np.triu_indices(len(used))

    def mean_parts(batches):
        total = sum((_whitened(fit, x, k)[:, used].sum(0) for b in batches for d, _, x in _vectors(b) if d == size), np.zeros(len(used)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(used))), pa.array(total)], ["i", "total"])

    sums = vectors.mapInArrow(mean_parts, "i long, total double").groupBy("i").agg(F.sum("total").alias("total")).collect()
    means = np.zeros(len(used))
    for r in sums:
        means[r["i"]] = r["total"] / fit.n

    def product_parts(batches):
        total = np.zeros((len(used), len(used)))
        for b in batches:
            for d, _, x in _vectors(b):
                if d == size:
                    w = _whitened(fit, x, k)[:, used] - means
                    total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(upper[0]), pa.array(upper[1]), pa.array(total[upper])], ["i", "j", "total"])

    products = vectors.mapInArrow(product_parts, "i long, j long, total double").groupBy("i", "j").agg((F.sum("total") / F.lit(fit.n)).alias("c"))
    apart = F.abs(F.col("c") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return products.agg(F.max(apart)).first()[0]


def whitened(embeddings: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Every vector on the first components of the covariance of all of them, at unit variance.

    Entries c become whole numbers x = floor(64 * c) + 1,000,000; the
    covariance is exact (fit_whitening) and its eigenvectors are taken once.
    Returns for each row and component vec_id, component (from 1), n (vectors
    fitted), deviation (decimal, sum over dimensions of (n * x - S) ** 2,
    exact), whitened, explained (share of the trace) and identity_error (one
    value for all rows).

    Vectors that are null, empty, or hold entries that are null, not finite or
    of a size that no long holds (64 * c from 2 ** 61 on) take no part, nor do
    those with another number of dimensions than most (of equals the larger
    number). Null and repeated ids, and repeated vectors, are rows of their
    own. With fewer dimensions than components there is one component a
    dimension. Along a component without variance whitened is null; without
    any variance explained and identity_error are null too. deviation is null
    where it has over 38 digits. An empty table gives no rows.
    """
    vectors = embeddings.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.col(quoted(vec_col)).cast("array<double>").alias("vec"))
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fit = fit_whitening(vectors)
    if fit is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    k = min(components, len(fit.low))
    error = _identity_error(vectors, fit, k)
    explained = np.maximum(fit.values[:k], 0) / fit.trace if fit.trace > 0 else np.full(k, np.nan)

    def project(batches):
        for batch in batches:
            for size, rows, x in _vectors(batch):
                if size != len(fit.low):
                    continue
                w = _whitened(fit, x, k).ravel()
                ids, each = pa.array(np.repeat(rows, k)), len(rows) * k
                parts = np.tile(explained, len(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(ids),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(each, fit.n)),
                        _deviations(fit, x).take(pa.array(np.repeat(np.arange(len(rows)), k))),
                        pa.array(w, mask=np.isnan(w)),
                        pa.array(parts, mask=np.isnan(parts)),
                        pa.array([error] * each, pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.mapInArrow(project, schema)
