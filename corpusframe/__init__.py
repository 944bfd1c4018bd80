"""corpusframe: corpus building, retrieval and evaluation as Spark jobs."""
