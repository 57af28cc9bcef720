"""A document-memory analytics engine on Spark DataFrames."""
