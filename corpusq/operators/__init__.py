"""Operators: functions from DataFrames to a DataFrame, for whole batches of queries."""
