"""Relational operators: encoding, binning, calibration, trees, leaf aggregates."""
