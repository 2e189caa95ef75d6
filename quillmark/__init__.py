"""Preference-data and training-corpus analytics as Spark DataFrame jobs."""
