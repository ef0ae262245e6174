"""Code and document graph queries as Spark DataFrame jobs."""
