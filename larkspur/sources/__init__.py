"""Readers of the supported inputs as DataFrames."""
