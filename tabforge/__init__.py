"""Tabular machine-learning analytics written as Spark jobs."""
