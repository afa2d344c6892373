"""Tracewell: signal-evidence analytics on Spark DataFrames."""
