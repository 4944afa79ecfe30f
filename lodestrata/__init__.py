"""A lakehouse processing engine on Spark's DataFrame API and Structured Streaming."""
