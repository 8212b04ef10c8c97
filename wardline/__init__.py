"""Batch quality, drift, fairness, decision-impact and release-evidence operators on Spark DataFrames."""

__version__ = "0.1.0"
