"""sentrine: payment-fraud analytics on Spark DataFrames and Structured Streaming."""
