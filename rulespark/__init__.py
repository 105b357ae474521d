"""A decision-table engine on Spark DataFrames."""
