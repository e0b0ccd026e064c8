"""Structured Streaming dataflows."""
