"""Compatibility-report analytics on PySpark DataFrames."""
