"""Structured Streaming front end for the narrow operators."""
