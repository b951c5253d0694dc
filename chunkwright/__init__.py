"""De-duplication and storage analytics on Spark DataFrames."""
