"""Event-time operators as Structured Streaming queries with batch twins."""
