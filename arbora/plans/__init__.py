"""The sampler: proposals, sweeps, the loop, and the estimators on top."""
