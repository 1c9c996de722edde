"""Column functions: text, code, tables and geometry."""
