"""A federated, declarative query engine whose plans are Spark DataFrames."""
