"""Aggregates that set a model up: each is one pass, and gives the driver a few numbers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions.special import invgamma_ppf, norm_ppf


def offset_columns(y: Column, binary: bool) -> list[Column]:
    """n valid rows and their mean; of a binary response, the share that is not zero, within [1 / (n+1), n / (n+1)]."""
    n = F.count(y)
    share = F.avg((y != 0).cast("double"))
    mean = F.greatest(1 / (n + 1), F.least(n / (n + 1), share)) if binary else F.avg(y.cast("double"))
    return [n.alias("n"), F.coalesce(mean, F.lit(0.5 if binary else 0.0)).alias("mean")]


def offset(df: DataFrame, y: str, binary: bool = False) -> float:
    mean = df.agg(*offset_columns(F.col(y), binary)).first()["mean"]
    return norm_ppf(mean) if binary else mean


def leaf_precision(df: DataFrame, y: str, trees: int, k: float = 2.0, binary: bool = False) -> float:
    """(k sqrt(trees) / tau)^2 with tau half the response's range, 1 if fewer than two rows are valid, 3 if it is binary."""
    tau = 3.0
    if not binary:
        r = df.agg(F.count(y).alias("n"), ((F.max(y) - F.min(y)) / 2).cast("double").alias("tau")).first()
        tau = r["tau"] if r["n"] >= 2 else 1.0
    return math.inf if tau == 0 else (k * math.sqrt(trees) / tau) ** 2


def summary(df: DataFrame, ys: list[str]) -> list[dict]:
    """Of each response n, mean, share of non-zero values, half range and population variance, all in one pass."""
    d = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"y{j}") for j, c in enumerate(ys)])
    row = d.agg(*[f.alias(f"{n}{j}") for j in range(len(ys)) for n, f in (
        ("n", F.count(f"y{j}")), ("mean", F.avg(f"y{j}")), ("share", F.avg((F.col(f"y{j}") != 0).cast("double"))), ("tau", (F.max(f"y{j}") - F.min(f"y{j}")) / 2), ("variance", F.var_pop(f"y{j}")),
    )]).first()
    return [{k: row[f"{k}{j}"] for k in ("n", "mean", "share", "tau", "variance")} for j in range(len(ys))]


def offset_of(s: dict, binary: bool) -> float:
    if not s["n"]:
        return 0.0
    return norm_ppf(max(1 / (s["n"] + 1), min(s["n"] / (s["n"] + 1), s["share"]))) if binary else s["mean"]


def precision_of(s: dict, trees: int, k: float, binary: bool) -> float:
    tau = 3.0 if binary else s["tau"] if s["n"] >= 2 else 1.0
    return math.inf if tau == 0 else (k * math.sqrt(trees) / tau) ** 2


def response_variance(df: DataFrame, y: str, scale: str | None = None) -> DataFrame:
    """(n, mean, variance): of the population; with error scales s, of weights 1 / s^2: sum(w (y - mean)^2) / n."""
    d = df.where(F.col(y).isNotNull()).select(F.col(y).cast("double").alias("y"), (1 / (F.col(scale) * F.col(scale)) if scale else F.lit(1.0)).alias("w"))
    s = d.agg(F.count("*").alias("n"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("mean"))
    return d.crossJoin(F.broadcast(s)).groupBy("n", "mean").agg((F.sum(F.col("w") * (F.col("y") - F.col("mean")) ** 2) / F.first("n")).alias("variance"))


def guarded(variance: float | None) -> float:
    return variance if variance and math.isfinite(variance) and variance > 0 else 1.0


def ols_sigma2(df: DataFrame, x: list[str], ys: list[str]) -> list[float | None]:
    """Residual variances of least squares with intercept, n - rank degrees of freedom, from one pass over all products.

    Predictors and responses are centered at their means in a first pass of the same size, against cancellation.
    """
    cols = [F.col(c).cast("double") for c in [*x, *ys]]
    n, *means = df.agg(F.count("*"), *[F.avg(c) for c in cols]).first()
    if n <= len(x) + 1:
        return [None] * len(ys)
    d = [c - F.lit(m) for c, m in zip(cols, means, strict=True)]
    pairs = [(i, j) for i in range(len(d)) for j in range(i, len(d)) if i < len(x) or i == j]
    g = np.zeros((len(d), len(d)))
    for (i, j), v in zip(pairs, df.agg(*[F.sum(d[i] * d[j]) for i, j in pairs]).first(), strict=True):
        g[i, j] = g[j, i] = v
    p = len(x)
    s = np.sqrt(np.maximum(np.diag(g)[:p], 1e-300))
    q, b = g[:p, :p] / np.outer(s, s), g[:p, p:] / s[:, None]
    rank = int(np.linalg.matrix_rank(q, tol=1e-10)) if p else 0
    fit = (b * (np.linalg.pinv(q, rcond=1e-10) @ b)).sum(axis=0) if p else np.zeros(len(ys))
    return [float(max(0.0, g[p + k, p + k] - fit[k]) / (n - rank - 1)) for k in range(len(ys))]


def sigma_prior(sigma2: float, df: float = 3.0, quantile: float = 0.9) -> float:
    """Scale lambda for which the ``quantile`` of df * lambda / chi2(df) is sigma2."""
    return sigma2 / (df / 2 * invgamma_ppf(quantile, df / 2))


def standardized(df: DataFrame, y: str, binary: bool = False) -> tuple[float, float]:
    """Mean and population sd; of a binary response, the normal quantile of its mean, and 1."""
    r = df.agg(F.avg(y).cast("double").alias("m"), F.stddev_pop(y).alias("s")).first()
    return (norm_ppf(min(max(r["m"], 1e-6), 1 - 1e-6)), 1.0) if binary else (r["m"] or 0.0, r["s"] or 1.0)


def precision_scales(df: DataFrame, scale: str | None, y: str) -> DataFrame:
    """Adds w = 1 / scale^2, 0 where y is missing; and y0, y or null."""
    w = 1 / (F.col(scale) * F.col(scale)) if scale else F.lit(1.0)
    return df.withColumn("w", F.when(F.col(y).isNull(), 0.0).otherwise(w))


def p_nonterminal(depths: int, base: float = 0.95, power: float = 2.0) -> list[float]:
    """Prior probability that a node at each depth splits; none at the last."""
    return [base / (1 + d) ** power for d in range(depths - 1)] + [0.0]
