"""Column-level helpers: they take Columns and return Columns."""
