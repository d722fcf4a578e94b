"""Column expressions: arguments and results are Spark columns."""
