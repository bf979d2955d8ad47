"""Tabular risk-classification analytics as Spark DataFrame jobs."""
