"""Spark-first operators for validating and analysing scientific job data."""
