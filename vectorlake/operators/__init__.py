"""Retrieval operators over DataFrames."""
