"""Column functions: every one maps columns to a column and stays in the JVM."""
