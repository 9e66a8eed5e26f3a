"""Evaluation analytics on Spark DataFrames: preparation, matching, statistics, metrics, models."""
