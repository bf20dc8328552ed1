"""Column functions and DataFrame operations that Catalyst plans by itself."""
