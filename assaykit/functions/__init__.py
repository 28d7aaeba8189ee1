"""Scalar functions and rule packs."""
