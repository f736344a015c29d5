"""Column expressions; every one stays inside code generation."""
