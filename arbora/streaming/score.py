"""Predictions for the rows of a stream: no state, so one plan serves both batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from arbora.operators.trees import latent
from arbora.plans.estimator import Bart


def score_stream(model: Bart, stream: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, prediction) of a streaming DataFrame, the posterior mean; the samples must fit one broadcast."""
    if any(model.model.binary):
        raise ValueError("means of binary responses aggregate over samples; score them by batch")
    rows = model.binned(stream, keys)
    return latent(rows, keys, model.trace, model.model.offset, mean=True).withColumnRenamed("latent", "prediction")
