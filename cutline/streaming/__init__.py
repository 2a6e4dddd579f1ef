"""Structured Streaming forms of point-in-time rates."""
