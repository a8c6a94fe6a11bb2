"""Operators over media tables: DataFrame in, DataFrame out."""
