"""Column functions: every one returns a Spark ``Column`` and runs inside the JVM."""
