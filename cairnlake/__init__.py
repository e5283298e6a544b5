"""Long-term text memory analytics as Spark DataFrame operators."""
