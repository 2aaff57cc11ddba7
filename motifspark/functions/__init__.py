"""Functions on small patterns that Spark has no expressions for."""
