"""lexmill: document-collection analytics on Spark DataFrames."""
