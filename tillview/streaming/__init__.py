"""Structured Streaming: event parsing, windowed counts, ingestion and keyed sinks."""
