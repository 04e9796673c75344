"""Recommendation and ranking analytics over DataFrames."""
