"""Analytics operators: each takes frames and parameters and returns a lazy frame."""
