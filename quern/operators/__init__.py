"""Corpus jobs as functions from DataFrames to a DataFrame."""
