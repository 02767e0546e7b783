"""Column expressions, all built from JVM-side functions unless stated."""
