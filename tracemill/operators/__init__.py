"""Operators on lines, records and tables; each takes and gives DataFrames."""
