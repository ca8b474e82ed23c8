"""Column-level functions (scalar expressions)."""
