"""Column functions: rounding, statistics, text rules and the sales calendar."""
