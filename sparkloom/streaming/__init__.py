"""Spark streaming."""
