"""Structured Streaming jobs over delivery logs."""
