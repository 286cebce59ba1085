"""Ranked join analytics on PySpark."""
