"""Scalar library: fixed values and column functions."""
