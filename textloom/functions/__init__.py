"""Column expressions over text; nothing here leaves the JVM."""
