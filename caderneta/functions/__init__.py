"""Column -> Column functions; none of them leaves the JVM."""
