"""Operators of the payables engine."""
