"""A search, memory and text analytics engine on Spark DataFrames."""
