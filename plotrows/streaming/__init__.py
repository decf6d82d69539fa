"""Structured Streaming form of the metric log (S10 appends -> A4 rollups)."""
