"""A multi-model query engine on Spark DataFrames."""
