"""Scalar functions as column expressions, and probability tails as pandas functions."""
