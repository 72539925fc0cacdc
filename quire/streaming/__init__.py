"""Structured Streaming: incremental index and running merges."""
