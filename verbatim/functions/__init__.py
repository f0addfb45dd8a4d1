"""Column expressions (JVM-side built-ins only)."""
