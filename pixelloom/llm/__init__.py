"""Operators for preparing training data at corpus scale, built on Spark DataFrames."""
