"""weirstream: streaming SQL on Spark DataFrames."""
