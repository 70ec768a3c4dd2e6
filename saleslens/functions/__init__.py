"""Column expressions and row-level derived columns. Built-in Spark functions only."""
