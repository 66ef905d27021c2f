"""Relational, ranking, graph and similarity operators: DataFrames in, DataFrames out."""
