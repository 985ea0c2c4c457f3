"""Marketplace sales analytics as Spark DataFrame jobs."""
