"""lintel: clause retrieval and review analytics as Spark DataFrame programs."""
