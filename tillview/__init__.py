"""Retail analytics operators for Spark: pure ``DataFrame -> DataFrame`` functions."""
