"""Where matrices and vectors come from."""
