"""Article retrieval, ranking and ingestion as Spark jobs."""
