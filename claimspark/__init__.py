"""Claims-denial analytics as Spark DataFrame jobs."""
