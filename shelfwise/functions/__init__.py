"""Column expressions shared by the analyses."""
