"""Chunked and streaming ingestion built on Structured Streaming."""
