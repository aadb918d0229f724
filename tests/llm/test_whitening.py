import math

import numpy as np
import pytest

from evispark.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, component int, n string"


def vectors(n=300, dim=40, seed=2):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dim, dim))
    return [(i, [float(x) for x in (rng.normal(size=dim) @ mix).astype(np.float32)], 7, "z") for i in range(n)]


ODD = [(900, None, 1, "a"), (901, [float("nan")] + [0.0] * 39, 1, "a"), (902, [None] + [1.0] * 39, 1, "a"), (903, [float("inf")] * 40, 1, "a"), (904, [0.0] * 40, 1, "a"), (905, [], 1, "a"), (906, [1.0, 2.0], 1, "a"), (None, [3.0] * 40, 1, "a"), (5, [1.5] * 40, 1, "a"), (5, [1.5] * 40, 1, "a")]


def brute(rows):
    fine = [(k, v) for k, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(len(v) for _, v in fine)
    x = [[math.floor(64 * c) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in fine]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    z = [[n * a - s for a, s in zip(row, sums)] for row in x]
    return [k for k, _ in fine], n, [sum(a * a for a in row) for row in z], np.array(z, float) / n


def test_equals_plain_linear_algebra(spark):
    rows = vectors() + ODD
    keys, n, deviation, c = brute(rows)
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    got = whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == n * 32 and {r.n for r in got} == {n}
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted(zip(map(str, keys), deviation))
    whitened = c @ axes[:, :32] / np.sqrt(values[:32])
    for j in range(32):
        mine = sorted((str(r.vec_id), r.deviation, r.whitened) for r in got if r.component == j + 1)
        want = [w for *_, w in sorted(zip(map(str, keys), deviation, whitened[:, j]))]
        have = np.array([w for *_, w in mine])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-6
        assert {round(r.explained, 9) for r in got if r.component == j + 1} == {round(values[j] / values.sum(), 9)}
    assert 0 <= got[0].identity_error < 1e-9 and len({r.identity_error for r in got}) == 1


def test_fewer_places_and_repeated_rows(spark):
    rows = [(i, [float(i % 3), 2.0], 0, "") for i in range(9)]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.component, r.whitened is None) for r in got} == {(1, False), (2, True)} and got[0].identity_error < 1e-9
    same = whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, "")] * 3, SCHEMA)).collect()
    assert len(same) == 6 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error is None for r in same)


@pytest.mark.parametrize("rows", [[], [(1, None, 0, "")], [(1, [], 0, "")]])
def test_nothing_to_whiten(spark, rows):
    assert whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_values_beyond_64_bits(spark):
    rows = [(1, [1e30, 1.0], 0, ""), (2, [-1e30, 2.0], 0, ""), (3, [5e10, -1.0], 0, "")]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got) and got[0].n == 3


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2**20 + i), float(3 * i)], 0, "") for i in range(4)]
    _, _, deviation, _ = brute(rows)
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted({(r.vec_id, r.deviation) for r in got}) == list(enumerate(deviation))
