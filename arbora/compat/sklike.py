"""An estimator with ``sample`` and ``predict`` and parameters in dictionaries, on a standardized response."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions.special import ndtr
from arbora.operators import calibrate
from arbora.operators.binning import RangeEvenBinner
from arbora.operators.encode import Encoder
from arbora.plans.estimator import Bart


class NotSampledError(RuntimeError):
    pass


@dataclass
class GeneralParams:
    cutpoint_grid_size: int = 256
    standardize: bool = True
    sample_sigma2_global: bool = True
    sigma2_global_init: float | None = None
    sigma2_global_shape: float = 0.0
    sigma2_global_scale: float = 0.0
    variable_weights: list[float] | None = None
    random_seed: int = 0
    keep_every: int = 1
    num_chains: int = 1
    outcome: str = "continuous"
    link: str = "identity"


@dataclass
class MeanForestParams:
    num_trees: int = 200
    alpha: float = 0.95
    beta: float = 2.0
    min_samples_leaf: int = 5
    max_depth: int = 10
    sigma2_leaf_init: float | None = None
    sample_sigma2_leaf: bool = False

    def __post_init__(self) -> None:
        if not 1 <= self.max_depth <= 16:
            raise ValueError("max_depth must be from 1 to 16")
        if self.sample_sigma2_leaf:
            raise NotImplementedError("the leaf variance is not sampled")


def build(cls: type, given: dict | None) -> object:
    unknown = set(given or {}) - {f.name for f in fields(cls)}
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    return cls(**(given or {}))


def variance_prior(shape: float, scale: float) -> tuple[float, float]:
    """IG(shape, scale) as degrees of freedom and scale of the sd."""
    if (shape > 0) != (scale > 0):
        raise ValueError("give both shape and scale, or none")
    return (2 * shape, math.sqrt(scale / shape)) if shape else (0.0, 1.0)


class BARTModel:
    """Ordered categories become ranks, others indicators; the response is standardized; predictions are on its scale."""

    def __init__(self) -> None:
        self.bart: Bart | None = None

    def is_sampled(self) -> bool:
        return self.bart is not None

    def sample(self, df: DataFrame, features: list[str], y: str, *, num_gfr: int = 0, num_burnin: int = 0, num_mcmc: int = 100, encoder: Encoder | None = None, row_id: str | None = None, weights: str | None = None, general_params: dict | None = None, mean_forest_params: dict | None = None) -> "BARTModel":
        if num_gfr:
            raise NotImplementedError("there is no grow-from-root sampler; num_gfr must be 0")
        g, m = build(GeneralParams, general_params), build(MeanForestParams, mean_forest_params)
        if (g.outcome, g.link) not in (("continuous", "identity"), ("binary", "probit")):
            raise ValueError("outcome and link must be continuous and identity, or binary and probit")
        self.probit = g.outcome == "binary"
        if self.probit and weights:
            raise NotImplementedError("a probit model takes no weights")
        self.encoder = (encoder or Encoder()).fit(df, features)
        names = [f"x{i}" for i in range(len(self.encoder.names))]
        x = df.withColumns(dict(zip(names, self.encoder.encoded(), strict=True)))
        if g.variable_weights is not None:
            g.variable_weights = self.encoder.weights(g.variable_weights)
        self.mean, self.sd = calibrate.standardized(df, y, self.probit) if g.standardize or self.probit else (0.0, 1.0)
        x = x.withColumn("_y", F.col(y).cast("double") if self.probit else (F.col(y) - self.mean) / self.sd)
        leaf = m.sigma2_leaf_init or (2.0 if self.probit else 1.0) / m.num_trees
        df0, s0 = variance_prior(g.sigma2_global_shape, g.sigma2_global_scale)
        if weights:
            x = x.withColumn("_s", 1 / F.sqrt(weights))
        self.names = names
        self.bart = Bart(
            x, names, "_y", outcome="binary" if self.probit else "continuous", error_scale="_s" if weights else None, row_id=row_id, num_trees=m.num_trees, n_burn=num_burnin, n_save=num_mcmc, n_skip=g.keep_every,
            num_chains=g.num_chains, maxdepth=m.max_depth + 1, base=m.alpha, power=m.beta, sigma_df=df0 or 1e-6, sigma_scale=None if self.probit else s0 if df0 else math.sqrt(g.sigma2_global_init or 1.0),
            offset=self.mean if self.probit else 0.0, tau_num=2 * math.sqrt(m.num_trees * leaf), k=2.0, binner=lambda d, f: RangeEvenBinner(d, f, g.cutpoint_grid_size), min_points_per_decision_node=None,
            min_points_per_leaf=m.min_samples_leaf, varprob=g.variable_weights, seed=g.random_seed,
        )
        return self

    def predict(self, df: DataFrame | str, keys: list[str] | None = None, type: str = "posterior", terms: str = "y_hat", scale: str = "linear") -> DataFrame:  # noqa: A002
        """type: posterior (a row for each sample) or mean; scale: linear, probability or class (of a probit model)."""
        if self.bart is None:
            raise NotSampledError("call sample first")
        if type not in ("posterior", "mean") or scale not in ("linear", "probability", "class") or terms not in ("y_hat", "mean_forest", "all"):
            raise ValueError("unknown type, terms or scale")
        if scale != "linear" and not self.probit:
            raise ValueError("probabilities and classes are of probit models")
        if not isinstance(df, str):
            keys = keys or [c for c in df.columns if c not in self.encoder.columns]
            df = df.withColumns(dict(zip(self.names, self.encoder.encoded(), strict=True))).select(*keys, *self.names)
        d = self.bart.predict(df, "latent_samples", keys)
        keys = [c for c in d.columns if c not in ("chain", "sample", "prediction")]
        f = F.col("prediction")[0]
        f = f if self.probit else f * self.sd + self.mean
        d = d.select(*keys, "chain", "sample", (ndtr(f) if scale != "linear" else f).alias("y_hat"))
        if type == "mean":
            d = d.groupBy(*keys).agg(F.avg("y_hat").alias("y_hat"))
        return d.withColumn("y_hat", (F.col("y_hat") > 0.5).cast("double")) if scale == "class" else d
