"""NumPy kernels on one trace; none of them imports Spark."""
