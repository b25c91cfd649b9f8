"""Evaluation analytics over free-text model answers, as PySpark DataFrame functions."""
