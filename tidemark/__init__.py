"""tidemark: a layered real-time warehouse on Spark DataFrames and Structured Streaming."""
