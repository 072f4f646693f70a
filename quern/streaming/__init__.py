"""Structured Streaming: the access quota, deduplication with late data, and recent history per user."""
