"""Whitening against plain big-integer arithmetic and numpy, one vector after another."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from loomspan.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def _table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], SCHEMA).repartition(parts)


def _plain(rows):
    """x-vectors, n, sums, exact covariance of plain Python integers."""
    held = [(i, v) for i, v in rows if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in held]
    n, sums = len(xs), [sum(col) for col in zip(*xs)]
    ys = [[n * x - s for x, s in zip(v, sums)] for v in xs]
    d = len(sums)
    cov = [[Fraction(sum(y[i] * y[j] for y in ys), n**3) for j in range(d)] for i in range(d)]
    return held, ys, n, cov


def _random(count, width, seed, scale=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, scale * (1 + k)) for k in range(width)]) for i in range(count)]


def _against_plain(spark, rows, parts=3):
    got = w.whiten(_table(spark, rows, parts)).collect()
    held, ys, n, cov = _plain(rows)
    d = len(cov)
    values, axes = np.linalg.eigh(np.array([[float(v) for v in line] for line in cov]))
    values, axes = values[::-1], axes[:, ::-1]
    k = min(8, d)
    assert len(got) == len(held) * k and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == {i for i, _ in held}
    trace = float(sum(cov[i][i] for i in range(d)))
    coordinates = np.array([[y / n for y in v] for v in ys]) @ axes[:, :k] / np.sqrt(values[:k])
    signs = np.sign([[by[held[0][0]][c + 1].whitened] for c in range(k)])[:, 0] * np.sign(coordinates[0])
    for (i, _), y, line in zip(held, ys, coordinates):
        for c in range(k):
            r = by[i][c + 1]
            assert r.deviation == sum(v * v for v in y)
            assert r.explained == pytest.approx(values[c] / trace, rel=1e-9)
            assert r.whitened == pytest.approx(signs[c] * line[c], abs=1e-7)
            assert r.identity_error <= 1e-9
    assert len({r.identity_error for r in got}) == 1
    return got


def test_against_plain_arithmetic(spark):
    _against_plain(spark, _random(300, 12, 1))
    _against_plain(spark, _random(40, 3, 2, 1e-3), parts=7)


def test_reruns_and_partitions_agree(spark):
    rows = _random(200, 6, 3)
    one, two = ({(r.vec_id, r.component): (r.deviation, r.explained, r.identity_error) for r in w.whiten(_table(spark, rows, p)).collect()} for p in (4, 4))
    assert one == two
    other = {(r.vec_id, r.component): (r.deviation, r.explained) for r in w.whiten(_table(spark, rows, 9)).collect()}
    assert other == {k: v[:2] for k, v in one.items()}


def test_bad_vectors_are_dropped(spark):
    rows = _random(50, 4, 4)
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [float("nan"), 0.0, 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0, 0.0]), (105, [1.0, 2.0])]
    got = w.whiten(_table(spark, rows + bad)).collect()
    assert {r.vec_id for r in got} == {i for i, _ in rows}
    assert {(r.vec_id, r.component): r.deviation for r in got} == {(r.vec_id, r.component): r.deviation for r in w.whiten(_table(spark, rows)).collect()}


def test_rows_without_variance(spark):
    assert w.whiten(_table(spark, [])).collect() == []
    assert w.whiten(_table(spark, [(1, None)])).collect() == []
    same = w.whiten(_table(spark, [(i, [1.0, 2.0, 3.0]) for i in range(5)])).collect()
    assert len(same) == 15 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in same)
    flat = w.whiten(_table(spark, [(None if i == 3 else i % 7, [float(i), 2.0 * i, 5.0]) for i in range(20)])).collect()
    assert len(flat) == 60 and sum(r.vec_id is None for r in flat) == 3
    assert all((r.whitened is not None) == (r.component == 1) for r in flat) and flat[0].identity_error <= 1e-9


def test_entries_of_any_size(spark):
    """Products beyond a long are exact, too; deviations beyond one are null."""
    rows = [(i, [float(np.float32(10.0 ** (i % 12))), float(i)]) for i in range(60)]
    got = {(r.vec_id, r.component): r for r in w.whiten(_table(spark, rows)).collect()}
    _, ys, n, _ = _plain(rows)
    for i, y in enumerate(ys):
        exact = sum(v * v for v in y)
        assert got[i, 1].deviation == (exact if exact < 1 << 63 else None)
    huge = w.whiten(_table(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge if r.vec_id != 3)


def test_limb_products_are_exact(monkeypatch):
    monkeypatch.setattr(w, "_FOLD", 3)
    rng = random.Random(5)
    for bits in (5, 20, 41, 60, 90):
        rows = [[[rng.randint(-(1 << bits), 1 << bits) for _ in range(3)] for _ in range(17)] for _ in range(8)]
        count = w.limb_count(1 << bits)
        product = w.LimbProduct(count, count, 3)
        for block in rows:
            matrix = np.array(block, object if bits > 60 else np.int64)
            sliced = w.limbs(matrix, count)
            assert np.abs(sliced).max() <= 1 << 19
            product.add(sliced, sliced)
        exact = [[sum(r[i] * r[j] for b in rows for r in b) for j in range(3)] for i in range(3)]
        assert product.result().tolist() == exact


def test_digits_round_trip():
    rng = random.Random(6)
    for _ in range(200):
        v = rng.randint(-(1 << 150), 1 << 150) >> rng.randint(0, 149)
        parts = w.digits(v)
        assert sum(p << 32 * k for k, p in enumerate(parts)) == v and all(abs(p) <= 1 << 31 for p in parts)
