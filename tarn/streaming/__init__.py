"""Structured Streaming over tables."""
