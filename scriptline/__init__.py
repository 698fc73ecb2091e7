"""Prescribing analytics as lazy PySpark DataFrame pipelines."""
