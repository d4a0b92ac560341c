"""Column helpers: expressions that stay inside the JVM."""
