"""Operators for large text and vector corpora (training-data preparation).

Nothing else in the package imports this subpackage. Every operator takes
DataFrames and column names and returns a DataFrame; ``queries`` holds the
registered ``opN_`` queries and ``oracle`` their SQL.
"""
