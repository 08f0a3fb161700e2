"""Column functions: texts, times and vectors."""
