"""Column expressions and small plan fragments shared by the operators."""
