"""Governed analytics on Spark DataFrames: results, history, catalogue, access, retrieval, streams."""
