"""Column expressions (JVM-side unless stated otherwise)."""
