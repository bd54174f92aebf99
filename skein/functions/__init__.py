"""Column functions; all run in the JVM unless they say otherwise."""
