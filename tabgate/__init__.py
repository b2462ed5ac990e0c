"""Checks, loads, releases and exports tabular metadata submissions as Spark jobs."""
