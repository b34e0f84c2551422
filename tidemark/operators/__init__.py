"""Relational, search and state operators on DataFrames."""
