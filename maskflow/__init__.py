"""Finds and protects personal data in DataFrames."""
