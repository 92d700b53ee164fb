"""Column helpers. Everything here returns built-in Spark expressions."""
