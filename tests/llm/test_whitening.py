"""Whitening against exact fractions and plain numpy."""

from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusq.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def _plain(rows):
    """{vec_id: [deviation]} in order, n, the covariance as fractions, the centred rows."""
    kept = [(i, [floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    cov = [[sum((x[i] - Fraction(sums[i], n)) * (x[j] - Fraction(sums[j], n)) for x in fit) / n for j in range(d)] for i in range(d)]
    return kept, n, sums, cov


def _check(rows, out):
    kept, n, sums, cov = _plain(rows)
    assert len(out) == len(kept) * min(4, len(sums))
    values, _ = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    values = values[::-1]
    trace = float(sum(cov[k][k] for k in range(len(sums))))
    expected = sorted((i, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in kept)
    assert sorted((r.vec_id, r.deviation) for r in out if r.component == 1) == expected
    assert {r.n for r in out} == {n}
    for r in out:
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9)
        assert r.identity_error < 1e-9
    # whitened values of the fit list: their covariance is the identity
    by = {}
    for r in out:
        by.setdefault(r.vec_id, {})[r.component] = r.whitened
    first = {}
    for i, x in kept:
        first.setdefault(tuple(x), by[i])
    z = np.array([[w[k] for k in sorted(w)] for w in first.values()])
    assert np.allclose(np.cov(z.T, bias=True), np.eye(z.shape[1]), atol=1e-9)
    assert np.allclose(z.mean(axis=0), 0, atol=1e-9)


def test_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").limit(120).collect()]
    _check(rows, whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect())
    assert queries.op11_whitening(spark, sf).count() == 2000


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    draw = np.random.default_rng(5)
    good = [(i, (draw.normal(size=6) + 300).astype(np.float32).tolist()) for i in range(70)]
    rows = good + good[:20] + [(900, good[0][1]), (901, None), (902, [1.0, nan, 0.0, 0.0, 0.0, 0.0]), (903, [inf, 0.0, 0.0, 0.0, 0.0, 0.0]), (904, [None, 0.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"x": F.lit("mine"), "n": F.lit(1), "component": F.lit(7)})
    _check(rows, whitening.whiten(df).collect())
    unnamed = spark.createDataFrame([(None, v) for _, v in good], SCHEMA)
    assert whitening.whiten(unnamed).count() == 280


def test_empty_poor_and_ragged_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], SCHEMA)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect()
    assert len(one) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in one)
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(5)], SCHEMA)).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-9 for r in line)
    ragged = whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 0.0]), (3, [0.0, 5.0]), (4, [])], SCHEMA)).collect()
    assert len(ragged) == 8 and {r.n for r in ragged} == {3}


def test_results_do_not_depend_on_partitions(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    one, many = (sorted(map(tuple, whitening.whiten(rows.repartition(k)).collect())) for k in (1, 13))
    # all but the last digits of identity_error, whose sums are floating point
    assert [r[:4] for r in one] == [r[:4] for r in many]
    assert np.allclose([r[4:6] for r in one], [r[4:6] for r in many], rtol=1e-12, atol=1e-12)


@given(st.lists(st.lists(st.integers(-(1 << 62), (1 << 62) - 1), min_size=3, max_size=3), min_size=1, max_size=90))
@settings(max_examples=60, deadline=None)
def test_counts_of_planes_are_exact_products(rows):
    x = np.array(rows, np.int64)
    low, high = int(x.min()), int(x.max())
    planes = max(1, (high - low).bit_length())
    counts = whitening.pair_counts(whitening.bit_planes(x, low, planes))
    value = lambda i, j: sum(int(c) << k for k, c in enumerate(counts[i, j]))
    y = [[int(c) - low for c in r] + [1] for r in rows]
    for i in range(4):
        for j in range(i, 4):
            assert value(i, j) == sum(r[i] * r[j] for r in y)


def test_large_numbers_stay_exact(spark):
    rows = [(k, [float(k << 40), float(3 - k)]) for k in range(4)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    kept, n, sums, cov = _plain(rows)
    assert all(r.deviation is None for r in out)  # beyond a long
    assert out[0].explained == pytest.approx(1.0)
