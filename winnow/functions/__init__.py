"""Column functions: expressions only, no Python code in the plan."""
