"""Column expressions and window helpers; all of them run inside the JVM."""
