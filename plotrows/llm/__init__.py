"""Operators of a training-data pipeline over raw text and web pages."""
