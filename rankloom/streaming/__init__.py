"""Models fed by Structured Streaming, and request batching."""
