"""A rule and graph engine on Spark DataFrames."""
