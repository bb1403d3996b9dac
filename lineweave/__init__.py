"""Linear-reference coverage analytics, expressed as Spark DataFrames."""
