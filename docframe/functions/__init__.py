"""Scalar functions and expression builders; all are compositions of built-in column functions."""
