"""Trajectory analytics as Spark DataFrame jobs."""
