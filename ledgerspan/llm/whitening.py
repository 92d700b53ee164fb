"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation (operator 13).

X is the fit list (each distinct quantised vector once) centred by its mean. Lanczos alternates products X v and
X^T u over the rows, which stay on the executors: every step is one pass in which each task multiplies its rows
by a few d-vectors (numpy inside mapInPandas) and returns sums of fixed size. The left vectors u = X z are never
stored; their coefficients z (d numbers each) are. Both sequences are fully reorthogonalised: the u's with dot
products taken from the data in the same pass, the v's on the driver. The small bidiagonal matrix B (alpha on the
diagonal, beta above) is decomposed by SVD; its singular values give the covariance's eigenvalues
(sigma^2 / n) and V times its right singular vectors the components. Steps stop when the wanted Ritz pairs'
residuals beta_j * |p_j| are at rounding level, or the rank is exhausted (at most min(n, d) steps).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspan.llm.common import stage

#: Fixed values of the contract: the quantisation scale and the number of components returned.
SCALE = 256
COMPONENTS = 4
#: A Ritz pair counts as converged when its residual is below this share of the largest singular value.
TOLERANCE = 1e-12
SEED = 13


def quantised(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is present with only finite entries, with x = floor(SCALE * c) as array<long>.
    Vectors whose length differs from that of the longest usable vector are treated as unusable too."""
    finite = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    usable = embeddings.where(F.col(vector).isNotNull() & finite)
    return usable.withColumn("__x", F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE).cast("long")))


def _sums(fit: DataFrame, fn, width: int) -> np.ndarray:
    """Per task partial sums of `width` numbers (from fn over Arrow batches of rows x), added up in Spark."""
    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            if len(batch):
                total += fn(np.stack(batch["x"].to_numpy()).astype(np.float64))
        yield pd.DataFrame({"v": [total]})

    parts = fit.mapInPandas(run, "v array<double>")
    out = np.zeros(width)
    for row in parts.select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("s")).collect():
        out[row.pos] = row.s
    return out


def _orthogonalise(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            v = v - (b @ v) * b
    return v


def lanczos(fit: DataFrame, mean: np.ndarray, n: int, k: int = COMPONENTS, tolerance: float = TOLERANCE):
    """Top singular values and right singular vectors of the centred fit rows: (sigma, components d x r)."""
    d = len(mean)
    limit = min(n, d)
    v = np.random.default_rng(SEED).standard_normal(d)
    v /= np.linalg.norm(v)
    vs, zs, xtus, alphas, betas = [v], [], [], [], []
    z_prev, beta = np.zeros(d), 0.0
    sigma, right = np.zeros(0), np.zeros((d, 0))
    for j in range(limit):
        z = vs[-1] - beta * z_prev                      # u_j = X z before reorthogonalisation
        Z = np.array(zs).T if zs else np.zeros((d, 0))
        m = Z.shape[1]

        def product(X, z=z, Z=Z, m=m):
            centred = X - mean
            a = centred @ z                              # X v
            return np.concatenate([[a @ a], centred.T @ a, (centred @ Z).T @ a if m else []])  # |u|^2, X^T u, u . u_i

        s = _sums(fit, product, 1 + d + m)
        norm2, xtu, dots = s[0], s[1:1 + d], s[1 + d:]
        for i in range(m):                               # u_j minus its parts along u_1 .. u_{j-1}
            z, xtu = z - dots[i] * zs[i], xtu - dots[i] * xtus[i]
        alpha2 = norm2 - float(dots @ dots) if m else norm2
        if alpha2 <= 0 or np.sqrt(max(alpha2, 0.0)) <= tolerance * (alphas[0] if alphas else np.sqrt(max(norm2, 1e-300))):
            break
        alpha = np.sqrt(alpha2)
        z, xtu = z / alpha, xtu / alpha
        zs.append(z)
        xtus.append(xtu)
        alphas.append(alpha)
        nxt = _orthogonalise(xtu - alpha * vs[-1], vs)  # v_{j+1} = X^T u_j - alpha v_j, against all v's
        beta = float(np.linalg.norm(nxt))
        B = np.diag(alphas) + np.diag(betas, 1)
        P, sigma, Qt = np.linalg.svd(B)
        want = min(k, len(alphas))
        residual = beta * np.abs(P[-1, :want])
        right = np.array(vs[:len(alphas)]).T @ Qt.T
        if beta <= tolerance * sigma[0] or (len(alphas) >= k and np.all(residual <= tolerance * sigma[0])):
            break
        betas.append(beta)
        vs.append(nxt / beta)
        z_prev = z
    return sigma, right


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """For each usable row and component c <= k with a positive eigenvalue: key, component, n, deviation,
    whitened, explained, identity_error.

    n and S are the count and per-dimension sums of the fit list (distinct x vectors); deviation is
    sum_d (n x_d - S_d)^2, exact in decimals, returned as long (an error if it passes 64 bits). whitened is
    (x - S/n) . component / sqrt(e); explained is e / trace(V), the trace exact from integer sums;
    identity_error the largest |entry| of the whitened fit list's covariance minus the identity, one value.
    Components have unit length and their largest entry positive. Odd rows: null vectors, null or non-finite
    entries, or another length go; repeated vectors count once in the fit and each get their rows; fewer than
    two distinct vectors give no component and no row; other columns, of any name, are not carried.
    """
    rows = quantised(embeddings, vector)
    longest = rows.agg(F.max(F.size("__x"))).first()[0]
    if longest is None:
        return _empty(embeddings, key)
    rows = rows.where(F.size("__x") == longest).select(F.col(key).alias("__key"), "__x")
    fit = stage(rows.select(F.col("__x").alias("x")).distinct(), "whitening-fit")
    d = int(longest)
    stats = fit.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s"), F.sum(F.col("col") * F.col("col")).alias("q"))
    n = fit.count()
    S, Q = [0] * d, [0] * d
    for row in stats.collect():
        S[row.pos], Q[row.pos] = int(row.s), int(row.q)
    if n < 2 or d == 0:
        return _empty(embeddings, key)
    trace = sum(n * q - s * s for q, s in zip(Q, S)) / (n * n)  # exact integers, one division
    mean = np.array(S, dtype=np.float64) / n
    sigma, right = lanczos(fit, mean, n, k)
    values = sigma ** 2 / n
    keep = [i for i in range(min(k, len(values))) if values[i] > TOLERANCE * max(values[0], 1e-300)]
    if not keep or trace <= 0:
        return _empty(embeddings, key)
    comps = [right[:, i] * np.sign(right[np.argmax(np.abs(right[:, i])), i]) for i in keep]
    scaled = [c / np.sqrt(values[i]) for c, i in zip(comps, keep)]

    def covariance(X, mean=mean, W=np.array(scaled).T):
        w = (X - mean) @ W
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    r = len(keep)
    s = _sums(fit, covariance, r + r * r)
    first, second = s[:r] / n, s[r:].reshape(r, r) / n
    identity_error = float(np.max(np.abs(second - np.outer(first, first) - np.eye(r))))

    sums = F.array(*[F.lit(v) for v in S])
    dev = F.aggregate(F.zip_with("__x", sums, lambda x, s: (x * F.lit(n) - s).cast("decimal(38,0)")
                                 * (x * F.lit(n) - s).cast("decimal(38,0)")),
                      F.lit(0).cast("decimal(38,0)"), lambda acc, v: acc + v)
    centred = F.zip_with("__x", F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x.cast("double") - m)
    per = [F.struct(F.lit(c + 1).alias("component"),
                    _dot(centred, scaled[c]).alias("whitened"),
                    F.lit(float(values[keep[c]] / trace)).alias("explained")) for c in range(r)]
    out = rows.select("__key", dev.cast("long").alias("deviation"), F.explode(F.array(*per)).alias("__c"))
    return out.select(F.col("__key").alias(key), F.col("__c.component").cast("int").alias("component"),
                      F.lit(n).cast("long").alias("n"), "deviation", "__c.whitened", "__c.explained",
                      F.lit(identity_error).alias("identity_error"))


def _dot(values: Column, weights: np.ndarray) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(values, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def _empty(embeddings: DataFrame, key: str) -> DataFrame:
    kind = embeddings.schema[key].dataType.simpleString()
    return embeddings.sparkSession.createDataFrame(
        [], f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
