"""Lattica: spatial block-table analytics on Spark DataFrames."""
