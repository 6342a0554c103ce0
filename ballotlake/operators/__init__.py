"""The query operators: tables in, DataFrames out."""
