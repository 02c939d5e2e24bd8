"""Column expressions: every function here is Column -> Column, JVM side."""
