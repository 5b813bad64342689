"""Column functions: plain Spark expressions that stay inside generated code."""
