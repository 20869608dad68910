"""Small dense kernels: what happens on the driver per iteration, or per block on the executors."""
