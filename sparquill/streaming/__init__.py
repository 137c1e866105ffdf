"""Following a change log with Structured Streaming."""
