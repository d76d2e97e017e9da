"""Column and driver functions shared by operators."""
