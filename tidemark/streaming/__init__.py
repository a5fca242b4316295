"""Structured Streaming forms of ingestion, attachment and expiry."""
