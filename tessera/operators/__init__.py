"""Operators on segment, match and rating tables: DataFrame in, DataFrame out."""
