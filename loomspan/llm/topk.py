"""Exact top-k inner-product search by pivot-table elimination.

Vectors are integers floor(scale * x). A pivot table is built once: for every vector its coordinates in the space that the pivots
span (from its products with them, so from its distances to them) and the length of what lies outside. For a query q and a
candidate x the distance is at least sqrt(|q_P - x_P|^2 + (|q_rest| - |x_rest|)^2), the largest lower bound the pivots give,
so the product is at most q_P * x_P + |q_rest| * |x_rest|. Every query gets a first threshold, its k-th best product with a
bounded sample of the rows, which all tasks share. Candidates under it are eliminated; the others are evaluated in the order
of their bounds until no bound reaches the k-th score.

Rows stay in their block; queries travel to the blocks, in segments of bounded size, so a task holds one block and streams
queries past it.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do null ids, nor vectors whose
``scale * x`` is not finite; vectors of different length never meet; equal scores go to the smaller id; repeated rows are
separate candidates; scores beyond a long are its limits and tie there; fewer than k candidates give them all; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, pieces, shuffle_partitions

LONG_MAX, LONG_MIN = 2**63 - 1, -(2**63)
_EXACT = 2.0**52


def basis_of(pivots: np.ndarray) -> np.ndarray:
    """Orthonormal rows spanning the pivots; (0, dim) without pivots or where they vanish."""
    size = np.abs(pivots).max(initial=0)
    if not size or not np.isfinite(size):
        return np.empty((0, pivots.shape[1]))
    q, r = np.linalg.qr((pivots / size).T)
    return q.T[np.abs(np.diag(r)) > 1e-9]


def table_of(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Rows of the pivot table: coordinates in the pivots' space, then the length of the rest."""
    with np.errstate(over="ignore", invalid="ignore"):
        inside = x @ basis.T
        rest = np.sqrt(np.maximum((x**2).sum(1) - (inside**2).sum(1), 0))
    return np.concatenate([inside, rest[:, None]], 1)


def _slack(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What rounding can take from bounds or products, for each query. The rest of a vector that is nearly inside the pivots'
    space is off by up to about 1e-7 of its length."""
    with np.errstate(over="ignore", invalid="ignore"):
        return 1e-6 * np.sqrt((q**2).sum(1)) * np.sqrt((x**2).sum(1).max(initial=0)) + 1e-6


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products of one query with rows, held to the limits of a long, as Python integers."""
    a = [int(v) for v in q]
    return np.array([min(max(sum(s * int(t) for s, t in zip(a, row)), LONG_MIN), LONG_MAX) for row in x], object)


def _best(rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores; rows are in id order, so the smaller row wins a tie."""
    if scores.dtype == object:
        keep = sorted(range(len(rows)), key=lambda i: (-scores[i], rows[i]))[:k]
        return rows[keep], scores[keep]
    if len(rows) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        rows, scores = rows[keep], scores[keep]
    keep = np.lexsort((rows, -scores))[:k]
    return rows[keep], scores[keep]


class Block:
    """Rows of one length with their pivot table, in id order."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, table: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.x, self.ids, self.table = x[order], ids[order], table[order]
        self.largest = float(np.abs(x).max(initial=0))

    def search(self, q: np.ndarray, qid: np.ndarray, table: np.ndarray, floor: np.ndarray, k: int, step: int = 256) -> Iterator[tuple[int, np.ndarray, list[int], int]]:
        """For every query: its number, the ids and scores of its k best rows among those that reach its floor, and how many were
        evaluated. The query's own id is no candidate."""
        x, ids = self.x, self.ids
        exact = float(np.abs(q).max(initial=0)) * self.largest * x.shape[1] < _EXACT
        with np.errstate(over="ignore", invalid="ignore"):
            bounds = table @ self.table.T + _slack(q, x)[:, None]
        bounds[np.isnan(bounds)] = np.inf
        for i in range(len(q)):
            bound = bounds[i]
            bound[ids == qid[i]] = -np.inf
            now, s, seen = np.empty(0, np.int64), np.empty(0, float if exact else object), 0
            least = float(floor[i])
            left = np.flatnonzero((bound >= least) & (bound > -np.inf))
            while len(left):  # in bound order, more at a time
                some = left
                if len(left) > step:
                    some = np.sort(left[np.argpartition(-bound[left], step)[:step]])
                more = x[some] @ q[i] if exact else _products(q[i], x[some])
                seen += len(some)
                bound[some] = -np.inf
                now, s = _best(np.concatenate([now, some]), np.concatenate([s, more]), k)
                if len(s) >= k:
                    least = max(least, float(s[-1]) * (1 if exact else 1 - 1e-9 * np.sign(float(s[-1]))))
                left = left[(bound[left] >= least) & (bound[left] > -np.inf)]
                step *= 2
            step = 256
            yield i, ids[now], [int(v) for v in s], seen


def _stacked(column: pa.Array, at: list[int] | np.ndarray, dim: int) -> np.ndarray:
    return column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)


def _table(pivots: dict[int, np.ndarray], samples: dict[int, tuple[np.ndarray, np.ndarray]], k: int, every: int):
    """Adds each row's pivot table entry and, for queries, the first threshold."""
    bases = {d: basis_of(p) for d, p in pivots.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, ids = batch.column(2).to_numpy(), batch.column(1).to_numpy()
            entries, floors = [None] * len(dims), np.full(len(dims), -np.inf)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = _stacked(batch.column(3), at, d)
                for i, row in zip(at.tolist(), table_of(x, bases.get(d, np.empty((0, d))))):
                    entries[i] = row
                asks = np.flatnonzero(ids[at] % every == 0)
                if d in samples and len(asks):
                    seen, own = samples[d]
                    with np.errstate(over="ignore", invalid="ignore"):
                        s = x[asks] @ seen.T
                    s[ids[at][asks][:, None] == own[None, :]] = -np.inf
                    if s.shape[1] >= k and np.isfinite(s).all(1).any():
                        kth = np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k] - _slack(x[asks], seen)
                        floors[at[asks]] = np.where(np.isnan(kth) | ~(np.abs(kth) < 2.0**62), -np.inf, kth)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(entries, pa.list_(pa.float64())), pa.array(floors, pa.float64())], [*batch.schema.names, "entry", "floor"]
            )

    return run


def _search(k: int, chunk: int = 64):
    """Rows come by (dim, block, segment), the block's rows before the queries: the block is held, the queries stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        key, block = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("dim", "block", "segment"))))
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or asks[i] != asks[i - 1]], len(keys)]
            for a, b in zip(edges, edges[1:]):
                if b == a:
                    continue
                if keys[a] != key:
                    key, block, held = keys[a], None, []
                for lo in range(a, b, chunk if asks[a] else b - a):
                    at = np.arange(lo, min(lo + (chunk if asks[a] else b - a), b))
                    x, ids = _stacked(batch.column("v"), at, key[0]), batch.column("vec_id").take(pa.array(at)).to_numpy()
                    entries = batch.column("entry").take(pa.array(at))
                    entries = entries.flatten().to_numpy().reshape(len(at), -1)
                    if not asks[a]:
                        held.append((x, ids, entries))
                        continue
                    if block is None:
                        if not held:
                            break
                        block = Block(*(np.concatenate(c) for c in zip(*held)))
                    out: list[list] = [[], [], [], []]
                    rows = batch.column("row").take(pa.array(at)).to_pylist()
                    floors = batch.column("floor").take(pa.array(at)).to_numpy()
                    for i, found, scores, _ in block.search(x, ids, entries, floors, k):
                        for column, values in zip(out, ([rows[i]] * len(found), [int(ids[i])] * len(found), found.tolist(), scores)):
                            column.extend(values)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["row", "query_id", "vec_id", "score"])

    return run


def exact_top_k(
    vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, pivots: int = 48, sample: int = 1024, max_lengths: int = 16,
    block_values: int = 1 << 22, query_segment: int = 1 << 20,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each row whose id is divisible by ``every``.

    To the driver go at most ``sample`` rows, chosen by hash, of each of the ``max_lengths`` commonest vector lengths; the first
    ``pivots`` of them are the pivots (at most three quarters of the length). Vectors of rarer lengths are searched exactly, too,
    with bounds by lengths alone. Blocks hold about ``block_values`` components and are dealt by a hash of the row, so a vector
    shared by a third of all rows spreads.
    """
    e = F.col("embedding").cast("array<double>")
    ints = F.transform(e, lambda v: _floor(v * F.lit(float(scale))))
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v * F.lit(float(scale))) == F.lit(float("inf"))))
    base = cut(
        vectors.select(F.col("vec_id").cast("long"), e.alias("embedding"))
        .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
        .select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("embedding").alias("dim"), ints.alias("v")),
        "topk",
    )
    common = [(r["dim"], r["n"]) for r in base.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(max_lengths).collect()]
    order = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64(F.lit(3), "row"), "row"))
    chosen = base.filter(F.col("dim").isin([d for d, _ in common])).withColumn("n", order).filter(F.col("n") <= sample)
    seen = defaultdict(list)
    for r in chosen.select("dim", "n", "vec_id", "v").collect():
        seen[r["dim"]].append((r["n"], r["vec_id"], r["v"]))
    samples = {d: (np.array([x[2] for x in sorted(rows)], np.float64).reshape(len(rows), d), np.array([x[1] for x in sorted(rows)], np.int64)) for d, rows in seen.items()}
    first = {d: x[: min(pivots, 3 * d // 4)] for d, (x, _) in samples.items()}
    table = cut(base.mapInArrow(_table(first, samples, k, every), "row long, vec_id long, dim int, v array<double>, entry array<double>, floor double"), "topk-table")
    drop(base)
    is_query = F.col("vec_id") % every == 0
    n, n_q, values = table.agg(F.count("*"), F.count_if(is_query), F.coalesce(F.sum("dim"), F.lit(0))).first()
    tasks = shuffle_partitions(table.sparkSession)
    blocks = max(pieces(values, block_values), min(tasks, pieces(n, 4096)))
    segments = pieces(n_q, query_segment)
    own = lambda salt, of: F.pmod(F.xxhash64(F.lit(salt), "row"), F.lit(of))
    each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long")))
    rows = table.select("*", F.lit(False).alias("asks"), own(1, blocks).alias("block"), each(segments).alias("segment"))
    queries = table.filter(is_query).select("*", F.lit(True).alias("asks"), each(blocks).alias("block"), own(2, segments).alias("segment"))
    places = min(blocks * segments * max(1, len(common)), 16 * tasks)
    place = F.pmod(F.col("block") * segments + F.col("segment") + F.col("dim") * 7919, F.lit(places)).cast("int")
    met = rows.unionByName(queries).repartitionById(places, place).sortWithinPartitions("dim", "block", "segment", "asks")
    found = met.mapInArrow(_search(k), "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _floor(x):
    """Floor of a double as a double, whatever its size: beyond 2**52 doubles are whole."""
    return F.when(F.abs(x) < F.lit(_EXACT), F.floor(x).cast("double")).otherwise(x)
