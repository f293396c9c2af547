"""postmill: social-post analytics as plain Spark DataFrame jobs."""
