"""Estimators with the surfaces of two other packages, on the same sampler."""
