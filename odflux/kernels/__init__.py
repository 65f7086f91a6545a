"""Numpy kernels for zone graphs of a few hundred nodes; Spark spreads sources, seeds and years over tasks."""
