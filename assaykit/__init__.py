"""Data-quality and data-processing operators on Spark DataFrames."""
