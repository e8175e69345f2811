"""Text to typed graph to answers, as Spark DataFrame jobs."""
