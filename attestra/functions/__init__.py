"""Column builders: everything here returns native Spark expressions."""
