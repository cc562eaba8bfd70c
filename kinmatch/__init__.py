"""Record linkage and data processing over Spark DataFrames."""
