"""Ridership analytics as Spark DataFrame jobs: clean, roll up, window, model."""
