"""Clickstream analytics as Spark DataFrame operations."""
