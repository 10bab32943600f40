"""Document retrieval and operations analytics as Spark DataFrame jobs."""
