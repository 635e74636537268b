"""Structured Streaming forms of the library's incremental readers."""
