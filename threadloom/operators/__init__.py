"""Logical operators over messages, each a function from DataFrames to DataFrames."""
