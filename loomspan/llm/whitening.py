"""Embedding whitening over exact integer covariances.

Entries become integers, and every sum over rows is exact: integers are split into limbs of 20 bits, so that a float64 matrix product
over a block of rows holds no rounding, the products of limbs are recombined as big integers, and these are merged over all tasks as
digits of 32 bits. Only the d x d covariance reaches the driver, where it is rounded once and decomposed; rows never do.

Defined results: rows whose vector is null, empty or holds null, NaN or infinite entries are dropped, and so are those whose length is
not the most frequent one (of equals the longest). Entries beyond the range of a long are held to 2^62 either way. A null vec_id
stays null; repeated rows count as often as they occur. A component without variance (all rows equal, or fewer rows than dimensions) has
a null ``whitened`` and is not part of ``identity_error``; without any variance ``explained`` is null, too. A ``deviation`` beyond a
long is null. An empty table gives an empty result. Columns other than ``vec_id`` and ``embedding`` are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_KINDS = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), *[(n, pa.int64()) for n in ("n", "deviation")], *[(n, pa.float64()) for n in ("whitened", "explained", "identity_error")]])
_PARTIAL = pa.schema([("key", pa.int32()), ("digits", pa.list_(pa.int64()))])

SCALE, SHIFT, _HELD = 1024, 100_000, 1 << 62
#: A limb is at most 2^19 either way; products of two over a block of 2^12 rows stay under 2^50, and 2^10 blocks of those under 2^63.
_LIMB, _BLOCK, _FOLD = 20, 1 << 12, 1 << 10
_DIGIT = 32
#: Doubles are summed over tasks as multiples of 2^-60, in any order with the same result.
_FIXED = 60


def to_integers(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * vectors), -_HELD, _HELD).astype(np.int64) + SHIFT


def limb_count(bound: int) -> int:
    """Limbs that hold every integer up to ``bound`` either way."""
    return -(-(int(bound).bit_length() + 2) // _LIMB)


def limbs(values: np.ndarray, count: int) -> np.ndarray:
    """Signed limbs of a matrix of integers (int64, or Python's in an object array), lowest first, side by side as float64."""
    out = []
    for _ in range(count):
        low = ((values + (1 << _LIMB - 1)) & ((1 << _LIMB) - 1)) - (1 << _LIMB - 1)
        out.append(low.astype(np.float64))
        values = (values - low) >> _LIMB
    return np.concatenate(out, axis=1)


class LimbProduct:
    """Sum over blocks of ``left.T @ right`` for matrices of limbs, as big integers."""

    def __init__(self, left: int, right: int, width: int):
        self.shape, self.now, self.blocks = (left, width, right, width), 0, 0
        self.total = np.zeros((width, width), object)

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        self.now = self.now + (left.T @ right).astype(np.int64)
        self.blocks += 1
        if self.blocks == _FOLD:
            self._fold()

    def _fold(self) -> None:
        if self.blocks:
            products = self.now.reshape(self.shape).astype(object)
            for p in range(self.shape[0]):
                for q in range(self.shape[2]):
                    self.total = self.total + (products[p, :, q, :] << _LIMB * (p + q))
        self.now, self.blocks = 0, 0

    def result(self) -> np.ndarray:
        self._fold()
        return self.total


def digits(value: int) -> list[int]:
    """Signed digits of 32 bits, lowest first: sums of up to 2^31 of them fit a long."""
    out = []
    while value:
        low = ((value + (1 << _DIGIT - 1)) & ((1 << _DIGIT) - 1)) - (1 << _DIGIT - 1)
        out.append(low)
        value = (value - low) >> _DIGIT
    return out


def _partial(values: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([digits(int(v)) for v in values], pa.list_(pa.int64()))], schema=_PARTIAL)


def merged(rows: DataFrame, count: int) -> list[int]:
    """Big integers of keys 0 to ``count`` - 1, summed over all partial rows (key, digits). ``count`` is given by the dimension."""
    sums = rows.select("key", F.posexplode("digits").alias("pos", "digit")).groupBy("key", "pos").agg(F.sum("digit").alias("digit"))
    out = [0] * count
    for r in sums.collect():
        out[r["key"]] += r["digit"] << _DIGIT * r["pos"]
    return out


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """vec_id and vectors of blocks of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, _BLOCK):
            part = batch.slice(at, _BLOCK)
            yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part, but for their length."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(F.coalesce(F.size("embedding") > 0, F.lit(False)) & F.coalesce(fine, F.lit(False)))


@dataclass(frozen=True)
class Fit:
    """n vectors with sums ``sums`` per dimension; unit eigenvectors as columns of ``axes``, their eigenvalues and the trace."""

    n: int
    sums: tuple[int, ...]
    reach: int  # no |n x - S| is larger
    wide: bool  # n x or n x - S may not fit a long
    axes: np.ndarray
    values: np.ndarray
    trace: float
    error: float | None = None

    def centred(self, vectors: np.ndarray) -> np.ndarray:
        """n x - S of each entry, exact."""
        x = to_integers(vectors)
        if self.wide:
            return self.n * x.astype(object) - np.array(self.sums, object)
        return self.n * x - np.array(self.sums, np.int64)

    def usable(self) -> np.ndarray:
        """Components with a variance above the rounding of the decomposition."""
        return self.values > len(self.sums) * np.finfo(float).eps * self.values[:1]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        spread = np.sqrt(np.where(self.usable(), self.values, 1.0))
        return (centred.astype(np.float64) / self.n) @ (self.axes / spread)


def _over_blocks(width: int, start: Callable, step: Callable, end: Callable[..., list[int]]):
    """A task that folds its blocks of vectors into one partial row per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, seen = start(), False
        for _, vectors in _matrices(batches, width):
            state, seen = step(state, vectors), True
        if seen:
            yield _partial(end(state))

    return run


def _sums(rows: DataFrame, width: int, bound: int) -> list[int]:
    count = limb_count(bound)

    def step(total: list[int], vectors: np.ndarray) -> list[int]:
        each = limbs(to_integers(vectors), count).sum(axis=0).reshape(count, width)
        return [t + sum(int(each[p, d]) << _LIMB * p for p in range(count)) for d, t in enumerate(total)]

    return merged(rows.mapInArrow(_over_blocks(width, lambda: [0] * width, step, list), "key int, digits array<long>"), width)


def _products(rows: DataFrame, width: int, fit: Fit) -> np.ndarray:
    """Sum over rows of (n x - S) (n x - S)^T."""
    count = limb_count(fit.reach)
    upper = np.triu_indices(width)

    def step(product: LimbProduct, vectors: np.ndarray) -> LimbProduct:
        sliced = limbs(fit.centred(vectors), count)
        product.add(sliced, sliced)
        return product

    task = _over_blocks(width, lambda: LimbProduct(count, count, width), step, lambda p: p.result()[upper].tolist())
    out = np.zeros((width, width), object)
    out[upper] = merged(rows.mapInArrow(task, "key int, digits array<long>"), len(upper[0]))
    return out + np.triu(out, 1).T


def _identity_error(rows: DataFrame, width: int, fit: Fit) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity; their mean is taken off before multiplying."""
    used = np.flatnonzero(fit.usable())
    if not len(used):
        return None

    def mean_of(measure: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        step = lambda total, vectors: total + measure(fit.whitened(fit.centred(vectors))[:, used])
        fixed = lambda total: [round(v * (1 << _FIXED)) for v in total.reshape(-1).tolist()]
        task = _over_blocks(width, lambda: np.zeros(shape), step, fixed)
        sums = merged(rows.mapInArrow(task, "key int, digits array<long>"), int(np.prod(shape)))
        return np.array([s / (fit.n << _FIXED) for s in sums]).reshape(shape)

    mean = mean_of(lambda w: w.sum(axis=0), (len(used),))
    covariance = mean_of(lambda w: (w - mean).T @ (w - mean), (len(used), len(used)))
    return float(np.abs(covariance - np.eye(len(used))).max())


def fit_whitening(embeddings: DataFrame, components: int = 8) -> tuple[DataFrame, Fit] | None:
    """The rows that take part and the fit over all of them; None if there are none.

    Each pass reads the vectors and moves one row per task and entry of a d x d matrix at most, pre-aggregated in the task.
    """
    rows = valid_vectors(embeddings)
    shape = rows.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n"), F.min(F.array_min("embedding")).alias("lo"), F.max(F.array_max("embedding")).alias("hi"))
    first = shape.orderBy(F.desc("n"), F.desc("width")).first()
    if first is None:
        return None
    n, width = first["n"], first["width"]
    lo, hi = (int(v) for v in to_integers(np.array([first["lo"], first["hi"]], np.float64)))
    rows = rows.filter(F.size("embedding") == width)
    bound = max(abs(lo), abs(hi))
    sums = tuple(_sums(rows, width, bound))
    fit = Fit(n, sums, n * (hi - lo), 2 * n * bound >= _HELD, np.eye(width), np.ones(width), 1.0)
    products = _products(rows, width, fit)
    rounded = np.array([[v / n**3 for v in line] for line in products], np.float64)
    values, axes = np.linalg.eigh(rounded)
    order = np.argsort(-values, kind="stable")[:components]
    axes = axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    trace = sum(products[i, i] for i in range(width)) / n**3
    fit = Fit(n, sums, fit.reach, fit.wide, axes, values[order], trace)
    return rows, Fit(**{**fit.__dict__, "error": _identity_error(rows, width, fit)})


def _deviations(centred: np.ndarray, reach: int) -> list[int | None]:
    if centred.shape[1] * reach**2 < _HELD:
        return (centred.astype(np.int64) ** 2).sum(axis=1).tolist()
    exact = (centred.astype(object) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def whiten(embeddings: DataFrame, components: int = 8) -> DataFrame:
    """Columns ``SCHEMA``: each row's coordinates on the first ``components`` unit eigenvectors of x = floor(1024 c) + 100000, over the
    root of their eigenvalues."""
    fitted = fit_whitening(embeddings, components)
    if fitted is None:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    rows, fit = fitted
    width, k = len(fit.sums), len(fit.values)
    usable = fit.usable()
    told = [float(v / fit.trace) if fit.trace else None for v in fit.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _matrices(batches, width):
            m = len(ids)
            centred = fit.centred(vectors)
            place = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(place), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n)),
                    pa.array(_deviations(centred, fit.reach), pa.int64()).take(place),
                    pa.array(fit.whitened(centred).reshape(-1), mask=np.tile(~usable, m)), pa.array(told * m, pa.float64()), pa.array([fit.error] * (m * k), pa.float64()),
                ],
                schema=_KINDS,
            )

    return rows.mapInArrow(run, SCHEMA)
