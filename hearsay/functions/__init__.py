"""Column -> Column builders. All of them stay inside the JVM."""
