"""Scalar functions of record logs."""
