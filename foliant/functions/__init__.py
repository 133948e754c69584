"""Column functions built from Spark expressions, and a few Arrow UDFs."""
