"""Versioned, log-structured keyed data on Spark."""
