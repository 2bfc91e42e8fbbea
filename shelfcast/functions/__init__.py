"""Column expressions, all built from functions that run inside the JVM."""
