"""Glossa: statistical text analytics expressed as Spark DataFrames."""
