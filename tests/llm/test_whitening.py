"""Operator 11: whitening against a plain computation in integers and numpy."""

from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ticketsift.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int, n string"


def rows_of(spark, vectors, first=0):
    return spark.createDataFrame([(first + k, v, 0, "clash") for k, v in enumerate(vectors)], SCHEMA)


def plain(vectors):
    x = [[int(np.floor(256 * float(np.float32(c)))) for c in v] for v in vectors]
    listed = sorted(set(map(tuple, x)))
    n, d = len(listed), len(listed[0])
    sums = [sum(v[a] for v in listed) for a in range(d)]
    cov = np.array([[float(Fraction(sum((n * v[a] - sums[a]) * (n * v[b] - sums[b]) for v in listed), n**3)) for b in range(d)] for a in range(d)])
    return x, n, sums, cov


def test_matches_a_plain_computation(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 6)) @ rng.standard_normal((6, 6)) * 0.3
    vectors = [v.tolist() for v in np.concatenate([base, np.repeat(base[:1], 120, axis=0)])]
    got = wh.whiten(rows_of(spark, vectors).repartition(7)).collect()
    x, n, sums, cov = plain(vectors)
    values, axes = np.linalg.eigh(cov)
    assert len(got) == 4 * len(vectors) and {r["n"] for r in got} == {n}
    by = {(r["vec_id"], r["component"]): r for r in got}
    for k, v in enumerate(x):
        assert by[k, 1]["deviation"] == sum((n * c - s) ** 2 for c, s in zip(v, sums))
    for c in range(1, 5):
        mine = np.array([by[k, c]["whitened"] for k in range(len(x))])
        want = (np.array(x) - np.array(sums) / n) @ axes[:, -c] / np.sqrt(values[-c])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-9
        assert abs(by[0, c]["explained"] - values[-c] / values.sum()) < 1e-12
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0, None], [nan, 1.0], [1.0, inf], [0.1, 0.2], [0.1, 0.2], [0.3, -0.2], [0.2, 0.0], [1.0], [1e30, 0.0]]
    got = wh.whiten(rows_of(spark, odd).unionAll(spark.createDataFrame([(None, [0.1, 0.25], 1, "x")], SCHEMA))).collect()
    ids = {(r["vec_id"], r["component"]) for r in got}
    assert ids == {(k, c) for k in (5, 6, 7, 8, 10, None) for c in (1, 2)} | {(9, 1)}
    lone = next(r for r in got if r["vec_id"] == 9)
    assert (lone["n"], lone["deviation"], lone["whitened"], lone["identity_error"], lone["explained"]) == (1, 0, None, None, 0.0)
    wide = next(r for r in got if r["vec_id"] == 10)
    assert wide["deviation"] is None
    pair = [r for r in got if r["vec_id"] in (5, 6)]
    assert len({(r["component"], r["whitened"]) for r in pair}) == 2


def test_constant_and_dependent_dimensions(spark):
    rng = np.random.default_rng(5)
    a = rng.standard_normal(50)
    got = wh.whiten(rows_of(spark, [[float(t), 2 * float(t) // 1, 3.0] for t in np.round(a * 64) / 64])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in got)
    assert got[0]["identity_error"] < 1e-6


def test_empty_table(spark):
    out = wh.whiten(rows_of(spark, [[1.0]]).where("false"))
    assert out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**61), 2**61), min_size=3, max_size=3), min_size=1, max_size=12, unique_by=tuple))
def test_sums_and_deviations_are_exact(vectors):
    x = np.array(vectors, dtype=np.int64)
    n, sums = len(x), [sum(v[a] for v in vectors) for a in range(3)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    model = wh.Fit(n, sums, centre, [int(v) for v in wh.pair_squares(wh.centred(x, centre))])
    for a in range(3):
        for b in range(3):
            want = Fraction(sum((n * v[a] - sums[a]) * (n * v[b] - sums[b]) for v in vectors), n**3)
            assert model.cov[a, b] == float(want)
    assert model.deviations(x) == [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in vectors]


@given(st.integers(-(10**60), 10**60))
def test_limbs(value):
    assert sum(v << wh.LIMB * place for _, place, v in wh.limbs(0, value)) == value


@given(st.lists(st.integers(-(2**61), 2**61), max_size=8))
def test_encoding(values):
    x = np.array(values, dtype=np.int64)
    assert wh.decode(wh.encode(x)).tolist() == values
