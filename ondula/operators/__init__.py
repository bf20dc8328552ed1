"""Transforms over DataFrames of signals."""
