"""Data-processing operators on DataFrames."""
