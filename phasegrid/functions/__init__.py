"""Column builders: every function takes and returns Columns (or lists of them)."""
