"""Distributional evaluation of labelled vector clouds, as PySpark jobs."""
