"""Spark sources."""
