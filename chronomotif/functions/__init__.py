"""Column functions: canonical forms, statistics, information theory."""
