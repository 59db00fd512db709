"""Column expressions; nothing here runs Python code per row."""
