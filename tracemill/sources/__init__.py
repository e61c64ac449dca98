"""Files, archives and lines as DataFrames."""
