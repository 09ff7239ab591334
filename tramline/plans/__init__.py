"""Journey planning."""
