"""Synthetic regression data: linear and quadratic means of independent predictors, with noise of known variance.

The coefficients are drawn on the driver and are small; rows come from ``spark.range`` and counters. Every variance below
is in closed form: of the linear part sigma2_lin, of the quadratic part sigma2_quad given the coefficients' law, of the
noise sigma2_eps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.rng import row_uniforms
from arbora.functions.special import norm_cdf, truncated_normal


@dataclass(frozen=True)
class Family:
    """A standardized law: uniform on +-sqrt(3), ``levels`` even steps, or normal (levels None and normal True)."""

    levels: int | None = None
    normal: bool = False

    @property
    def kurtosis(self) -> float:
        if self.normal:
            return 3.0
        m = self.levels
        return 1.8 if m is None else 3 * (3 * m * m - 7) / (5 * (m * m - 1))

    def ppf(self, u: np.ndarray) -> np.ndarray:
        if self.normal:
            return truncated_normal(u, np.ones(u.shape, bool), np.full(u.shape, -np.inf))
        if self.levels is None:
            return (u - 0.5) * math.sqrt(12)
        i = np.minimum(np.floor(u * self.levels), self.levels - 1)
        return (i - (self.levels - 1) / 2) * math.sqrt(12 / (self.levels**2 - 1))

    def from_normal(self, z: np.ndarray) -> np.ndarray:
        return z if self.normal else self.ppf(np.clip(norm_cdf(z), 1e-16, 1 - 1e-16))

    def cdf(self, x: np.ndarray) -> np.ndarray:
        if self.normal:
            return norm_cdf(x)
        if self.levels is None:
            return np.clip(x / math.sqrt(12) + 0.5, 0, 1)
        i = np.round(x / math.sqrt(12 / (self.levels**2 - 1)) + (self.levels - 1) / 2)
        return (i + 0.5) / self.levels

    def quantize(self, x: np.ndarray, bins: int) -> np.ndarray:
        """Bins of equal probability."""
        return np.clip(np.floor(self.cdf(x) * bins), 0, bins - 1).astype(np.int32)


@dataclass(frozen=True)
class Scale:
    """Scales with E[s^2] = 1 and a given E[s^4]: constant, spike and slab, or gamma."""

    kind: str = "constant"
    fourth: float = 1.0

    @classmethod
    def from_peff(cls, kind: str, p: int, peff: float) -> "Scale":
        """As many effective predictors as ``peff`` of ``p``: E[s^4] = p / peff."""
        return cls(kind, p / peff)

    def sample(self, rng: np.random.Generator, p: int) -> np.ndarray:
        if self.kind == "constant" or self.fourth <= 1:
            return np.ones(p)
        if self.kind == "spike_slab":
            return np.where(rng.random(p) < 1 / self.fourth, math.sqrt(self.fourth), 0.0)
        lo, hi = 1e-6, 1e6  # shape a: E[g^4] / E[g^2]^2 = (a + 2)(a + 3) / (a (a + 1))
        for _ in range(200):
            a = math.sqrt(lo * hi)
            lo, hi = (a, hi) if (a + 2) * (a + 3) / (a * (a + 1)) > self.fourth else (lo, a)
        return rng.gamma(a, size=p) / math.sqrt(a * (a + 1))


def ring(n: int, q: int) -> np.ndarray:
    """(n, n): variables at most q / 2 apart on a circle, q + 1 in each row."""
    if q % 2 or q >= n:
        raise ValueError("q must be even and less than the number of variables")
    apart = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    return np.minimum(apart, n - apart) <= q // 2


@dataclass
class Params:
    p: int
    q: int
    sigma2_lin: float
    sigma2_quad: float
    sigma2_eps: float
    k: int | None = None
    lambda_: float | None = None
    offset: float | list[float] = 0.0
    x: Family = Family()
    coef: Family = Family(2)
    error: Family = Family(normal=True)
    scale: Scale = Scale()
    outcome: str | list[str] = "continuous"
    het_strength: float | None = None
    het_shape: str | None = None
    error_corr: list[list[float]] | None = None
    seed: int = 0
    beta: np.ndarray = field(init=False)
    a: np.ndarray = field(init=False)
    gamma: np.ndarray | None = field(init=False, default=None)
    relevant: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        if (self.k is None) != (self.lambda_ is None):
            raise ValueError("lambda_ goes with k")
        if (self.het_strength is None) != (self.het_shape is None) or self.het_shape == "vector" and self.k is None:
            raise ValueError("het_strength goes with het_shape, and vector with k")
        if self.x.kurtosis == 1 and self.q < 2:
            raise ValueError("q must be at least 2 for binary predictors")
        if isinstance(self.offset, list) and len(self.offset) != (self.k or 0):
            raise ValueError("offset must have one value for each component")
        rng, n = np.random.default_rng(self.seed), self.k or 1
        s, mu4 = self.scale.sample(rng, self.p), self.scale.fourth
        draw = lambda *shape: self.coef.ppf(rng.random(shape))
        lin = lambda m, size: draw(*m.shape) * m * np.sqrt(1 / size) * s
        quad = lambda m, size: draw(*m.shape) * m / np.sqrt(size * ((self.x.kurtosis - 1) * mu4 + self.q)) * s[:, None] * s
        every = np.ones((1, self.p))
        self.part = np.ones((1, self.p), bool)
        b, a, g = lin(every, self.p), quad(ring(self.p, self.q)[None], self.p), lin(every, self.p)
        if self.k is not None:
            self.part = partition(rng, self.p, n)
            inside = np.zeros((n, self.p, self.p))
            for j in range(n):
                at = np.flatnonzero(self.part[j])
                inside[j][np.ix_(at, at)] = ring(len(at), self.q)
            mix = lambda own, all_: math.sqrt(1 - self.lambda_) * own + math.sqrt(self.lambda_) * all_
            b, a = mix(lin(self.part, self.p / n), b), mix(quad(inside, self.p / n), a)
            g = mix(lin(self.part, self.p / n), g) if self.het_shape == "vector" else g
        self.beta, self.a = b * math.sqrt(self.sigma2_lin), a * math.sqrt(self.sigma2_quad)
        self.gamma = None if self.het_shape is None else g
        self.relevant = s > 0
        self.root = None
        if self.error_corr is not None:
            c = np.array(self.error_corr, float)
            d = np.sqrt(np.diag(c))
            self.root = np.linalg.cholesky(c / np.outer(d, d))

    @property
    def sigma2_mean(self) -> float:
        """Variance of a data set's mean over coefficients."""
        mu4 = self.scale.fourth
        return self.sigma2_quad * mu4 / ((self.x.kurtosis - 1) * mu4 + self.q)

    @property
    def sigma2_pop(self) -> float:
        return self.sigma2_lin + self.sigma2_quad + self.sigma2_eps

    @property
    def sigma2_pri(self) -> float:
        return self.sigma2_pop + self.sigma2_mean

    @property
    def het_variance(self) -> float | None:
        """Variance of the squared error multiplier."""
        if self.het_shape is None:
            return None
        mu4, kx, kg, p = self.scale.fourth, self.x.kurtosis, self.coef.kurtosis, self.p
        excess = (kg * kx * mu4 - 3) / p
        if self.het_shape == "vector":
            k, lam = self.k, self.lambda_
            r = p % k
            excess = excess * (lam**2 + (1 - lam) ** 2 * k) + 6 * lam * (1 - lam) * (kx * mu4 - 1) / p + 3 * (1 - lam) ** 2 * r * (k - r) / p**2
        return self.het_strength**2 * (2 + excess)

    def generate(self, spark: SparkSession, n: int) -> DataFrame:
        """(row_id, x, y, z, mu, error_scale): arrays of p, and of a value for each component."""
        binary = np.array([o == "binary" for o in ([self.outcome] * (self.k or 1) if isinstance(self.outcome, str) else self.outcome)])
        me = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                x = np.stack([me.x.ppf(row_uniforms(me.seed, 1, 0, ids, j)) for j in range(me.p)], axis=1)
                mu = x @ me.beta.T + np.einsum("ni,kij,nj->nk", x, me.a, x, optimize=True) + np.asarray(me.offset)
                normal = Family(normal=True)
                e = np.stack([normal.ppf(row_uniforms(me.seed, 2, 0, ids, j)) for j in range(mu.shape[1])], axis=1)
                e = me.error.from_normal(e @ me.root.T if me.root is not None else e)
                w = np.ones(mu.shape) if me.gamma is None else np.sqrt((1 - me.het_strength) + me.het_strength * (x @ me.gamma.T) ** 2) * np.ones(mu.shape)
                z = mu + e * w * math.sqrt(me.sigma2_eps)
                y = np.where(binary, z > 0, z)
                as_list = lambda v: pa.array(v.tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(as_list, (x, y, z, mu, w))], ["row_id", "x", "y", "z", "mu", "error_scale"])

        return spark.range(n).withColumnRenamed("id", "row_id").mapInArrow(run, "row_id long, x array<double>, y array<double>, z array<double>, mu array<double>, error_scale array<double>")


def partition(rng: np.random.Generator, p: int, k: int) -> np.ndarray:
    """(k, p): each variable in one of k sets whose sizes differ by one at most."""
    if p < k:
        raise ValueError("there are fewer variables than components")
    return np.arange(k)[:, None] == rng.permutation(np.arange(p) % k)[None]


def split(df: DataFrame, n_train: int, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(row_id) < n_train), df.where(F.col(row_id) >= n_train)


def wide(df: DataFrame, p: int) -> DataFrame:
    """x as columns x0, x1, ..."""
    return df.select("*", *[F.col("x")[j].alias(f"x{j}") for j in range(p)])
