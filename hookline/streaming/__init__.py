"""Structured Streaming form of the scoring path."""
