"""Cohort and data-set analytics on Spark DataFrames."""
