"""Column functions: all of them stay in the JVM, but for those of functions.arrow."""
