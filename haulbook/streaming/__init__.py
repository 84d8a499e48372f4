"""The feeds as Structured Streaming queries."""
