"""Dataflows from DataFrame to DataFrame."""
