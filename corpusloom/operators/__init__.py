"""Operators on DataFrames of the artifact model."""
