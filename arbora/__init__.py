"""Bayesian sum-of-trees regression as Spark dataflow."""

__version__ = "0.1.0"
