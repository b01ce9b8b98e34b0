"""Payables analytics on Spark."""
