"""Column-to-Column functions; all of them are built-in Spark expressions."""
