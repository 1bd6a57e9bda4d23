"""Fathomline: frame-sequence analytics and corpus preparation on Spark."""
