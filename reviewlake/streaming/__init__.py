"""Structured Streaming forms of the arrival-driven operators."""
