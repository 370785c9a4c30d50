"""Estimators in the manner of R's BART packages: ``mc_gbart`` and, for one chain, ``gbart``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions.special import ndtr
from arbora.operators import calibrate
from arbora.operators.binning import Binner, GivenSplitsBinner, RangeEvenBinner, UniqueQuantileBinner
from arbora.plans.estimator import Bart, Sparse


class mc_gbart:  # noqa: N801
    """type: wbart (continuous) or pbart (probit). ``x_test``: rows to predict at once.

    Without ``lambda_`` the error prior is set so that the ``sigquant`` quantile of its sd is ``sigest``, by default the
    residual sd of least squares, or the sd of y where there are not more rows than predictors.
    """

    def __init__(
        self, df: DataFrame, features: list[str], y: str, x_test: DataFrame | None = None, *, type: str = "wbart", w: str | None = None, xinfo: list[list[float]] | None = None, usequants: bool = False,  # noqa: A002
        numcut: int = 100, sparse: bool = False, theta: float | None = None, a: float = 0.5, b: float = 1.0, rho: float | None = None, varprob: list[float] | None = None, sigest: float | None = None, sigdf: float = 3.0,
        sigquant: float = 0.9, lambda_: float | None = None, k: float = 2.0, power: float = 2.0, base: float = 0.95, tau_num: float | None = None, offset: float | None = None, ntree: int | None = None,
        ndpost: int = 1000, nskip: int = 100, keepevery: int | None = None, mc_cores: int = 2, seed: int = 99, row_id: str | None = None, keys: list[str] | None = None, maxdepth: int = 6, engine: str = "auto",
    ):
        if type not in ("wbart", "pbart"):
            raise ValueError("type must be wbart or pbart")
        self.probit = type == "pbart"
        if self.probit and w is not None:
            raise ValueError("pbart takes no weights")
        ntree = ntree or (50 if self.probit else 200)
        keepevery = keepevery or (10 if self.probit else 1)

        def binner(d: DataFrame, f: list[str]) -> Binner:
            if xinfo is not None:
                return GivenSplitsBinner(f, xinfo)
            return UniqueQuantileBinner(d, f, numcut + 1, seed=seed, row_id=row_id) if usequants else RangeEvenBinner(d, f, numcut + 1)

        scale = None
        if not self.probit:
            if lambda_ is None:
                s2 = sigest**2 if sigest else calibrate.ols_sigma2(df.where(F.col(y).isNotNull()), features, [y])[0]
                s2 = s2 or calibrate.guarded(calibrate.response_variance(df, y).first()["variance"])
                lambda_ = calibrate.sigma_prior(s2, sigdf, sigquant)
            scale = math.sqrt(lambda_)
        self.bart = Bart(
            df, features, y, outcome="binary" if self.probit else "continuous", error_scale=w, row_id=row_id, num_trees=ntree, n_burn=nskip, n_save=-(-ndpost // mc_cores), n_skip=keepevery, num_chains=mc_cores, k=k,
            base=base, power=power, sigma_df=sigdf, sigma_scale=scale, offset=offset, tau_num=tau_num, binner=binner, min_points_per_decision_node=None, min_points_per_leaf=5,
            sparse=Sparse(theta, a, b, rho) if sparse else None, varprob=varprob, seed=seed, maxdepth=maxdepth, engine=engine,
        )
        self._test = None if x_test is None else self.predict(x_test, keys)

    def predict(self, df: DataFrame | str, keys: list[str] | None = None) -> DataFrame:
        """(keys, chain, sample, yhat): the forests' sums."""
        d = self.bart.predict(df, "latent_samples", keys)
        return d.withColumn("yhat", F.col("prediction")[0]).drop("prediction")

    def _mean(self, d: DataFrame, column: str) -> DataFrame:
        return d.groupBy(*[c for c in d.columns if c not in ("chain", "sample", column)]).agg(F.avg(column).alias(column))

    def _prob(self, d: DataFrame | None) -> DataFrame | None:
        return None if not self.probit or d is None else d.withColumn("prob", ndtr(F.col("yhat"))).drop("yhat")

    @property
    def yhat_train(self) -> DataFrame:
        return self.predict("train")

    @property
    def yhat_test(self) -> DataFrame | None:
        return self._test

    @property
    def yhat_train_mean(self) -> DataFrame | None:
        return None if self.probit else self._mean(self.yhat_train, "yhat")

    @property
    def yhat_test_mean(self) -> DataFrame | None:
        return None if self.probit or self._test is None else self._mean(self._test, "yhat")

    @property
    def prob_train(self) -> DataFrame | None:
        return self._prob(self.yhat_train)

    @property
    def prob_test(self) -> DataFrame | None:
        return self._prob(self._test)

    @property
    def prob_train_mean(self) -> DataFrame | None:
        return self._mean(self.prob_train, "prob") if self.probit else None

    @property
    def prob_test_mean(self) -> DataFrame | None:
        return self._mean(self.prob_test, "prob") if self.probit and self._test is not None else None

    @property
    def sigma(self) -> DataFrame | None:
        """Error sd of each iteration, burn-in included."""
        return None if self.probit else self.bart.diagnostics().select("chain", "iter", (1 / F.sqrt(F.col("prec")[0])).alias("sigma"))

    @property
    def sigma_(self) -> DataFrame | None:
        return None if self.probit else self.bart.diagnostics(burn=False).select("chain", "iter", (1 / F.sqrt(F.col("prec")[0])).alias("sigma"))

    @property
    def sigma_mean(self) -> float | None:
        return None if self.probit else self.sigma_.agg(F.avg("sigma")).first()[0]

    varcount = property(lambda self: self.bart.varcount())
    varcount_mean = property(lambda self: self.bart.varcount_mean())
    varprob = property(lambda self: self.bart.varprob())
    varprob_mean = property(lambda self: self.bart.varprob_mean())
    ndpost = property(lambda self: self.bart.ndpost)
    offset = property(lambda self: self.bart.model.offset[0])


class gbart(mc_gbart):  # noqa: N801
    """One chain."""

    def __init__(self, *args: object, **kw: object):
        if "mc_cores" in kw:
            raise TypeError("gbart runs one chain; see mc_gbart")
        super().__init__(*args, **kw, mc_cores=1)
