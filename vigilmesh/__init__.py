"""Telecom service-assurance analytics on Spark DataFrames and Structured Streaming."""
