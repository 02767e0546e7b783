"""Evidence retrieval, entity matching and text quality operators as Spark DataFrame jobs."""
