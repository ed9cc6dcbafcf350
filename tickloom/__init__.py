"""Market-microstructure analytics on Spark DataFrames and Structured Streaming."""
