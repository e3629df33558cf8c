"""Temporal graph-memory analytics on PySpark DataFrames."""
