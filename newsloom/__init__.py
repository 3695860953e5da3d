"""News-corpus analytics as Spark DataFrame jobs."""
