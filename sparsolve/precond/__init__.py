"""Preconditioners.  setup(matrix) builds, apply(space, src, dst) gives dst = M^-1 src."""
