"""Sinks: versioned tables and JSON, checked when they are read."""
