"""Jobs that audit the integrity of very large file collections on Spark."""
