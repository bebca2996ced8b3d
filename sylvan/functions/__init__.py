"""Scalar column expressions and small numeric kernels."""
