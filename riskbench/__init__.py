"""Leakage-safe evaluation of binary risk models, written as Spark jobs."""
