"""Snapshot, fingerprint and diff of tabular state on Spark.

Every operator is a plain function from DataFrames to a DataFrame; nothing
runs until a sink or the caller asks for it.
"""
