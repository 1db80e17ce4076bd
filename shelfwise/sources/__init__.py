"""Reading the retail tables and writing intermediate and repaired ones."""
