"""Array kernels of one frame: pure NumPy, no Spark."""
