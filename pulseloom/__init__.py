"""Wellness time-series analytics as Spark jobs."""
