"""Tessella: a Spark-first engine for grids, point clouds, drainage graphs and corpora."""

__version__ = "0.1.0"
