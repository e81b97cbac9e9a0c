"""Structured Streaming: sessions that advance as work arrives, and publishing once."""
