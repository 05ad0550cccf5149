"""Document and run analytics expressed as Spark DataFrames."""
