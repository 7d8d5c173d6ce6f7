"""Text annotation, label voting, agreement and classification as Spark DataFrame jobs."""
