"""Krylov methods, each written once against a vector space, and direct solvers."""
