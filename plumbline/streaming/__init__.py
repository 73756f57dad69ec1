"""Change feeds and continuously kept checks on Structured Streaming."""
