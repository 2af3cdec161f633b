"""Column functions and token counters."""
