"""Timestamped evidence analytics, declared as Spark DataFrames."""
