"""Streaming of the payables engine."""
