"""Operators for preparing training text, as functions from DataFrames to DataFrames."""
