"""Survey statistics over Spark DataFrames."""
