"""Functions of the payables engine."""
