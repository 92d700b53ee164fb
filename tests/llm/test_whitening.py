"""Whitening by Lanczos bidiagonalisation against a covariance eigendecomposition in numpy."""

import math

import numpy as np
import pytest

from ledgerspan.llm import whitening


def brute(rows, k=4):
    """Plain numpy: the contract's numbers from the rows (vec_id, vector)."""
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in usable)
    usable = [(i, v) for i, v in usable if len(v) == d]
    xs = {i: tuple(math.floor(np.float32(c).item() * 256) for c in v) for i, v in usable}
    fit = np.array(sorted(set(xs.values())), dtype=np.int64)
    n = len(fit)
    S = fit.sum(axis=0)
    V = np.cov(fit.T.astype(float), bias=True)
    e, vecs = np.linalg.eigh(V)
    order = np.argsort(e)[::-1][:k]
    out = {}
    for i, x in xs.items():
        x = np.array(x)
        dev = sum(int(n * a - s) ** 2 for a, s in zip(x, S))
        for c, j in enumerate(order):
            out[(i, c + 1)] = (n, dev, abs((x - S / n) @ vecs[:, j] / math.sqrt(e[j])), e[j] / np.trace(V))
    return out


def check(spark, rows, k=4):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    got = whitening.whiten(df, k=k).collect()
    want = brute(rows, k)
    assert {(r.vec_id, r.component) for r in got} == set(want)
    for r in got:
        n, dev, w, ex = want[(r.vec_id, r.component)]
        assert (r.n, r.deviation) == (n, dev)
        assert abs(abs(r.whitened) - w) <= 1e-6 * max(1.0, w)
        assert abs(r.explained - ex) <= 1e-4 * ex
        assert r.identity_error <= 1e-4
    return got


def test_clustered_vectors_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (6, 16))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(0, 0.2, 16)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None] + [0.0] * 14), (302, [float("nan")] * 16), (303, [float("inf")] + [0.0] * 15),
             (304, rows[0][1]), (304, rows[0][1]), (305, [0.5] * 3)]
    got = check(spark, rows)
    assert {r.vec_id for r in got} == set(range(300)) | {304}
    # one sign per component for all rows: copies of a vector agree
    same = {(r.component, r.whitened) for r in got if r.vec_id in (0, 304)}
    assert len(same) == 4


def test_isotropic_and_low_rank(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(200)]
    check(spark, rows)
    # rank two after quantisation (entries are multiples of 1/256): only two components have a positive eigenvalue
    basis = rng.integers(-20, 21, (2, 8))
    flat = [(i, [float(x) / 256 for x in (rng.integers(-3, 4, 2) @ basis)]) for i in range(100)]
    got = whitening.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in got} == {1, 2}
    assert max(r.identity_error for r in got) <= 1e-4


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(empty).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(one).count() == 0
