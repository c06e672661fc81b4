"""Structured Streaming ingestion and guards."""
