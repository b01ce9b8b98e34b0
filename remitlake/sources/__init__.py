"""Sources of the payables engine."""
