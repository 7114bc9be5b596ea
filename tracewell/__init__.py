"""tracewell: execution-plan log analytics as Spark DataFrames."""
