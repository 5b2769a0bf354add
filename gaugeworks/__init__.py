"""Metric intelligence and data landing as Spark DataFrame jobs."""
