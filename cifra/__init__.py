"""Inverse text normalization and text analytics on Spark DataFrames."""
