"""Live indexing with Structured Streaming."""
