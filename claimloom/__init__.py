"""Bulk audit of insurance claim bundles with Spark DataFrames."""
