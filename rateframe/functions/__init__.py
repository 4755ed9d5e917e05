"""Column expressions shared by several operators."""
